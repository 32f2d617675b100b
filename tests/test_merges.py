"""Merges of whole conversations against a replay, pair by pair."""

import datetime as dt
import random

import pytest

from folio.operators import chat as C

KEY = "book:{}::persona:{}::character:{}"
SCHEMA = "ordinal long, conversation_key string, persona_name string, character_name string, updated_at timestamp, messages array<string>, summary_cards array<string>, chat_summary string, auto_summary_last_end long, reading_prefix_summary map<string,string>, ai_underlines map<string,array<int>>"
FIELDS = ["conversation_key", "persona_name", "character_name", "updated_ms", "messages", "summary_cards", "chat_summary", "auto_summary_last_end", "reading_prefix_summary", "ai_underlines"]


def score(b):
    return len(b["messages"] or []) * 10**6 + len(b["summary_cards"] or []) * 1000 + b["updated_ms"]


def pair(keep, drop):
    first, second = (keep, drop) if score(keep) >= score(drop) else (drop, keep)
    longer = lambda c: first[c] if len(first[c] or []) >= len(second[c] or []) else second[c]
    return {
        "conversation_key": keep["conversation_key"],
        **{c: first[c] or second[c] or "" for c in ("persona_name", "character_name", "chat_summary")},
        **{c: longer(c) for c in ("messages", "summary_cards")},
        **{c: {**(second[c] or {}), **(first[c] or {})} for c in ("reading_prefix_summary", "ai_underlines")},
        **{c: max(first[c] or 0, second[c] or 0) for c in ("updated_ms", "auto_summary_last_end")},
    }


def replay(rows, preferred):
    groups = {}
    for r in sorted(rows, key=lambda r: r[0]):
        b = dict(zip(["conversation_key", "persona_name", "character_name", "updated_at", *FIELDS[4:]], r[1:], strict=True))
        at = b.pop("updated_at")
        b["updated_ms"] = (at - dt.datetime(1970, 1, 1)) // dt.timedelta(milliseconds=1) if at else 0
        whole = b["conversation_key"].startswith("book:") and b["persona_name"] and b["character_name"]
        who = (b["conversation_key"].split("::")[0], b["persona_name"].lower(), b["character_name"].lower()) if whole else r[0]
        if who not in groups:
            groups[who] = b
            continue
        old = groups[who]
        if preferred in (old["conversation_key"], b["conversation_key"]):
            keep, drop = (old, b) if old["conversation_key"] == preferred else (b, old)
        else:
            keep, drop = (old, b) if score(old) >= score(b) else (b, old)
        groups[who] = pair(keep, drop)
    return groups.values()


def shown(b):
    plain = {c: b[c] for c in FIELDS}
    for c in ("persona_name", "character_name", "chat_summary"):
        plain[c] = plain[c] or ""
    plain["auto_summary_last_end"] = plain["auto_summary_last_end"] or 0
    for c in ("reading_prefix_summary", "ai_underlines"):
        plain[c] = sorted((plain[c] or {}).items())
    for c in ("messages", "summary_cards"):
        plain[c] = list(plain[c] or [])
    return str(plain)


@pytest.mark.parametrize("seed", range(6))
def test_merges_equal_a_replay(spark, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(80):
        p, c, k = rng.choice(["Ann", "ANN", "Bo", "", None]), rng.choice(["Cy", "cy", "Di", ""]), rng.randrange(9)
        key = rng.choice([KEY.format(rng.randrange(2), k, k)] * 9 + ["broken"])
        # Scores that tie, and lists whose length makes a merged row overtake a later one.
        at = dt.datetime(1970, 1, 1) + dt.timedelta(milliseconds=rng.choice([0, 1000, 2000, 10**6, 2 * 10**6, 3 * 10**6]))
        maps = [{rng.choice("xyz"): f"{n}{i}" for n in range(rng.randrange(3))} or None for _ in range(2)]
        lists = [rng.choice([None, [], *[[f"{i}{n}" for n in range(rng.randrange(4))]] * 4]) for _ in range(2)]
        rows.append((i, key, p, c, rng.choice([at] * 9 + [None]), *lists, rng.choice(["", None, f"s{i}"]), rng.choice([None, rng.randrange(50)]), maps[0], maps[1] and {k: [i] for k in maps[1]}))
    preferred = [None, KEY.format(0, 3, 3), KEY.format(1, 5, 5)][seed % 3]
    got = C.merge_conversations(spark.createDataFrame(rows, SCHEMA).repartition(3), preferred)
    assert sorted(shown(r.asDict()) for r in got.collect()) == sorted(map(shown, replay(rows, preferred)))
