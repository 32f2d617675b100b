"""Spans that weak supervision adds, against a fixture that was labelled by hand."""

import re

from folio.llm import pii

#: Sentences; what is personal data beyond the base patterns stands in double angles, what only looks like it in none.
LABELLED = """
Please write to <<jane.doe [at] example [dot] com>> for the keys.
Our contact is <<info(at)garden(dot)org>> since May.
Mail <<k.meyer {at} firma {dot} de>> before noon.
You can write <<bob at mailhouse dot net>> as well.
The email <<anna [at] posta [dot] it>> is read twice a day.
Look at this dot matrix of points on the wall.
We met at noon dot by dot the picture grew.
She laughed at every dot painter in town.
Call <<(212) 555-0187>> after five.
My phone is <<415-555-0132>> at work.
Tel <<(030) 555 0199>> rings in the shop.
The mobile <<312 555 0145>> is off.
Ring <<(646) 555-0111>> and ask.
Telephone <<718-555-0166>> for a table.
Reset code +1 2 was sent.
The score was +3 - 4 in the end.
Charge the amex <<3782 822463 10005>> please.
Her card <<3714 496353 98431>> ends soon.
Visa <<4111.1111.1111.1111>> was used.
The mastercard <<5500_0000_0000_0004>> is blocked.
Credit card <<4012/8888/8888/1881>> is hers.
Parcel 9807915762804490 is on its way.
Parcel 2390409500648960 came back.
Parcel 3627072101032238 is lost.
Parcel 8807915762804491 weighs a pound.
Part 1234.5678.9012.3456 does not fit.
Part 9999.1111.2222.3334 is sold out.
Version 999.300.1.2 is out.
Build 1.2.3.999 failed at night.
Release 300.1.2.4 is older.
""".strip().split("\n")


def test_added_spans_against_hand_labels(spark):
    rows, want = [], {}
    for i, line in enumerate(LABELLED):
        marked = re.search(r"<<(.*?)>>", line)
        text = line.replace("<<", "").replace(">>", "")
        rows.append((i, text))
        want[i] = {(marked.start(), marked.start() + len(marked[1]))} if marked else set()
    got = {r["doc_id"]: {(s["start"], s["end"]) for s in r["spans"] if not s["base"]} for r in pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    right = sum(len(got[i] & want[i]) for i in want)
    found, asked = sum(map(len, got.values())), sum(map(len, want.values()))
    wrong = [(rows[i][1], got[i], want[i]) for i in want if got[i] != want[i]]
    print(f"precision {right}/{found}, recall {right}/{asked}", wrong)
    assert right >= 0.9 * found and right >= 0.9 * asked, wrong


def test_labelers_can_outvote_a_pattern():
    """A pattern of its own kind speaks for a candidate, and a failing check sum still decides."""
    p = pii.fit({"2|+++0+|2": 40, "2|+-+0+|2": 40, "2|0--0+|2": 40})
    assert p["2|+++0+|2"] > 0.9 and p["2|+-+0+|2"] < 0.5 and p["2|0--0+|2"] < 0.1


def test_order_of_rows_changes_nothing(spark):
    rows = [(i, line.replace("<<", "").replace(">>", "")) for i, line in enumerate(LABELLED)]
    one, two = (spark.createDataFrame(r, "doc_id long, text string").repartition(n) for r, n in ((rows, 1), (rows[::-1], 5)))
    a, b = ({r["doc_id"]: [(s["kind"], s["start"], s["end"]) for s in r["spans"]] for r in pii.find_pii(d).collect()} for d in (one, two))
    assert a == b
