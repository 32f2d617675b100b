"""Conversation analytics: windows over messages, merges of buckets and cards, lore and prompts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folio.functions.text import compact, identity_value, minute_stamp, parse_key, strip, token_estimate
from folio.operators.staging import cut

#: Rows of each side in a cell of a join whose result is all pairs.
CELL = 4096


def _ordered(*keys: str) -> Window:
    return Window.partitionBy("conversation_key").orderBy(*keys)


def pending_messages(messages: DataFrame) -> DataFrame:
    """Unsent user messages; where there are none, the last message if it is the user's."""
    whole = Window.partitionBy("conversation_key")
    pending = (F.col("sender") == "user") & ~F.col("sent_to_ai")
    some = F.max(pending.cast("int")).over(whole)
    last = F.max("msg_index").over(whole) == F.col("msg_index")
    marked = messages.withColumns({"_p": pending, "_s": some, "_l": last})
    return marked.where("_p or (_s = 0 and _l and sender = 'user')").drop("_p", "_s", "_l")


def time_gaps(messages: DataFrame, gap_minutes: int = 60) -> DataFrame:
    """``separated`` before messages that come at least the gap (an hour or more) after the one before."""
    gap = max(60, gap_minutes) * 60_000_000
    before = F.lag("ts").over(_ordered("ts", "id"))
    wide = F.unix_micros("ts") - F.unix_micros(before) >= gap
    return messages.withColumn("separated", F.coalesce(wide, F.lit(False)))


def last_n(messages: DataFrame, n: int) -> DataFrame:
    """The last n messages of each conversation; all of them for 0."""
    if n == 0:
        return messages
    rank = F.row_number().over(Window.partitionBy("conversation_key").orderBy(F.desc("msg_index")))
    return messages.withColumn("_r", rank).where(F.col("_r") <= n).drop("_r")


def summary_ranges(totals: DataFrame, n: int) -> DataFrame:
    """``(conversation_key, total, cursor)`` -> whole windows of n items after the cursor; the rest waits."""
    windows = F.floor((F.col("total") - F.col("cursor")) / n).cast("long")
    guarded = F.when(windows > 0, F.sequence(F.lit(0).cast("long"), windows - 1)).otherwise(F.array().cast("array<long>"))
    out = totals.select("conversation_key", "cursor", F.explode(guarded).alias("i"))
    return out.select("conversation_key", (F.col("cursor") + F.col("i") * n + 1).alias("start"), (F.col("cursor") + (F.col("i") + 1) * n).alias("end"))


def tail_appended(old: DataFrame, new: DataFrame) -> DataFrame:
    """Messages added to each conversation since ``old``, if the old ones are exactly its beginning; else none."""
    o = old.select("conversation_key", "msg_index", F.col("id").alias("_old"))
    met = new.join(o, ["conversation_key", "msg_index"], "full_outer")
    whole = Window.partitionBy("conversation_key")
    same = F.min(F.when(F.col("_old").isNotNull(), F.coalesce(F.col("_old") == F.col("id"), F.lit(False)).cast("int"))).over(whole)
    return met.withColumn("_same", same).where("_old is null and coalesce(_same, 1) = 1").select(*new.columns)


def strip_last_generation(messages: DataFrame) -> DataFrame:
    """Messages without the run of character rows at the end that has the last row's generation."""
    whole = Window.partitionBy("conversation_key")
    last = F.max(F.struct("msg_index", "sender", "generation_id")).over(whole)
    marked = messages.withColumn("_last", last)
    same = (F.col("sender") == "character") & (F.col("_last.generation_id").isNull() | F.col("generation_id").eqNullSafe(F.col("_last.generation_id")))
    back = Window.partitionBy("conversation_key").orderBy(F.desc("msg_index")).rowsBetween(Window.unboundedPreceding, 0)
    run = F.min(same.cast("int")).over(back)
    return marked.withColumn("_run", run).where("_run = 0").drop("_last", "_run")


def bucket_identity(key: Column, persona: Column, character: Column) -> Column:
    """Book and folded names by which conversations are one; null where a name or the key's form is missing."""
    book = F.coalesce(parse_key(key)["book_id"], F.lit("none"))
    ok = key.rlike(r"^book:(.+?)::persona:(.+?)::character:(.+)$") & (identity_value(persona) != "") & (identity_value(character) != "")
    return F.when(ok, F.concat(F.lit("book:"), book, F.lit("::persona-name:"), identity_value(persona), F.lit("::character-name:"), identity_value(character)))


def merge_conversations(buckets: DataFrame, preferred: str | None = None) -> DataFrame:
    """One row for each identity, as merging its rows pair by pair in order of ``ordinal`` gives; rows without an identity stay.

    ``buckets`` (ordinal, conversation_key, persona_name, character_name, updated_at) may have ``messages`` (array) or
    message_count, ``summary_cards`` (array) or summary_count, ``chat_summary``, ``auto_summary_last_end``, and maps by book
    ``reading_prefix_summary`` and ``ai_underlines``. In each pair the row with the higher score (messages, then summaries, then time)
    comes first, the one that was there before at a tie (or the preferred key). The longer list stays, the first one's at a tie; names and summary are
    the first one's unless it has none; maps are laid over each other, the first one's entries on top; cursors and times are the larger ones.

    What a pair gives depends on running maxima alone, so no group is gathered: windows say for each part
    which row it comes from last.
    """
    has = set(buckets.columns)
    size = lambda array, count: F.greatest(F.size(array), F.lit(0)) if array in has else F.coalesce(F.col(count), F.lit(0)) if count in has else F.lit(0)
    named = buckets.withColumn("_identity", bucket_identity(F.col("conversation_key"), F.col("persona_name"), F.col("character_name")))
    own = F.coalesce("_identity", F.concat(F.lit("\u0000"), F.col("ordinal").cast("string")))
    keyed = named.withColumns({"_id": own, "_ms": F.coalesce(F.unix_millis("updated_at"), F.lit(0)), "_m": size("messages", "message_count").cast("long"), "_c": size("summary_cards", "summary_count").cast("long")})
    before = Window.partitionBy("_id").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, -1)
    most = lambda c: F.max(c).over(before)
    score, bar = F.col("_m") * 1_000_000 + F.col("_c") * 1_000 + F.col("_ms"), most("_m") * 1_000_000 + most("_c") * 1_000 + most("_ms")
    tied = F.col("conversation_key") == preferred if preferred is not None else F.lit(False)
    ranked = keyed.withColumn("_wins", F.coalesce((score > bar) | (score == bar) & tied, F.lit(True)))
    longer = lambda c: F.coalesce((F.col(c) > most(c)) | (F.col(c) == most(c)) & F.col("_wins"), F.lit(True))
    some = {c: F.coalesce(F.col(c), F.lit("")) != "" for c in ("persona_name", "character_name", "chat_summary") if c in has}
    marks = {f"_take_{c}": ok & (F.col("_wins") | (F.coalesce(F.sum(ok.cast("int")).over(before), F.lit(0)) == 0)) for c, ok in some.items()}
    marked = ranked.withColumns({"_take_m": longer("_m"), "_take_c": longer("_c"), **marks})
    last = lambda value, mark: F.max_by(value, F.when(F.col(mark), F.col("ordinal")))
    survivor = last("conversation_key", "_wins")
    chosen = survivor if preferred is None else F.coalesce(F.max(F.when(F.col("conversation_key") == preferred, F.col("conversation_key"))), survivor)
    lists = [last(c, m).alias(c) for c, m in (("messages", "_take_m"), ("summary_cards", "_take_c")) if c in has]
    texts = [F.coalesce(last(c, f"_take_{c}"), F.lit("")).alias(c) for c in some]
    cursor = [F.max(F.coalesce("auto_summary_last_end", F.lit(0))).alias("auto_summary_last_end")] * ("auto_summary_last_end" in has)
    out = marked.groupBy("_id").agg(chosen.alias("conversation_key"), *texts, F.max("_m").alias("message_count"), F.max("_c").alias("summary_count"), F.max("_ms").alias("updated_ms"), F.count("*").alias("merged"), *cursor, *lists)
    for c in ("reading_prefix_summary", "ai_underlines"):
        if c in has:
            # An entry comes from the last row that has its key and came first in its pair, or else from the first that has it.
            entries = ranked.select("_id", "ordinal", "_wins", F.explode(c).alias("k", "v"))
            first = F.row_number().over(Window.partitionBy("_id", "k").orderBy("ordinal")) == 1
            laid = entries.withColumn("_take", F.col("_wins") | first).groupBy("_id", "k").agg(last("v", "_take").alias("v"))
            # Gathered are the books of one conversation.
            out = out.join(laid.groupBy("_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("k", "v")))).alias(c)), "_id", "left")
    return out.drop("_id")


def archive_options(buckets: DataFrame, current: str) -> DataFrame:
    """One conversation for each identity: the current one, else the newest; rows without identity all stay."""
    ident = bucket_identity(F.col("conversation_key"), F.col("persona_name"), F.col("character_name"))
    own = F.coalesce(ident, F.concat(F.lit("\u0000"), F.col("ordinal").cast("string")))
    order = Window.partitionBy("_id").orderBy(F.desc((F.col("conversation_key") == current).cast("int")), F.desc("updated_at"), "ordinal")
    return buckets.withColumn("_id", own).withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_id", "_r")


def merge_cards(cards: DataFrame, chosen: DataFrame) -> DataFrame:
    """For owners with two chosen cards or more: these as one, texts by (start, end, created) with a blank line between."""
    picked = cards.join(chosen, ["owner_id", "card_id"], "left_semi")
    part = F.struct("start", "end", "created_at", "card_id", F.trim("content").alias("t"))
    # An owner's own chosen cards are gathered, no more.
    texts = F.filter(F.transform(F.array_sort(F.collect_list(part)), lambda c: c["t"]), lambda t: t != "")
    merged = picked.groupBy("owner_id").agg(F.count("*").alias("n"), F.array_join(texts, "\n\n").alias("content"), F.min("start").alias("start"), F.max("end").alias("end")).where("n > 1 and content <> ''")
    gone = picked.join(merged.select("owner_id"), "owner_id", "left_semi").select("owner_id", "card_id")
    rest = cards.join(gone, ["owner_id", "card_id"], "left_anti").select("owner_id", "card_id", "content", "start", "end")
    return rest.unionByName(merged.select("owner_id", F.lit(None).cast(cards.schema["card_id"].dataType).alias("card_id"), "content", "start", "end"))


def archive_validity(buckets: DataFrame, personas: DataFrame, characters: DataFrame, messages: DataFrame) -> DataFrame:
    """Whether both profiles of a conversation exist; names fall back to the last message's sender."""
    last = messages.groupBy("conversation_key").agg(F.max_by("sender_name", F.when(F.col("sender_name").isNotNull(), F.col("msg_index"))).alias("inferred"))
    p = personas.select(F.col("name").alias("persona_name"), F.lit(True).alias("_p"))
    c = characters.select(F.col("name").alias("character_name"), F.lit(True).alias("_c"))
    met = buckets.join(p, "persona_name", "left").join(c, "character_name", "left").join(last, "conversation_key", "left")
    shown = F.coalesce(F.nullif(compact(F.coalesce("character_name", F.lit(""))), F.lit("")), F.col("inferred"))
    return met.select(*buckets.columns, (F.coalesce("_p", F.lit(False)) & F.coalesce("_c", F.lit(False))).alias("valid"), shown.alias("shown_name"))


def bind_lore(characters: DataFrame, lore: DataFrame) -> DataFrame:
    """Lore entries of the categories that each character is bound to."""
    bound = cut(characters.select("character_id", F.explode("categories").alias("category")).withColumn("category", strip(F.col("category"))).where("category <> ''").distinct())
    # Each pair is a row of the result. Categories with many pairs are dealt as cells of CELL by CELL rows at most, each of one task.
    count_ = lambda df, name: df.groupBy("category").agg(F.ceil(F.count("*") / CELL).cast("int").alias(name))
    # There are fewer such categories than rows / CELL.
    wide = cut(count_(bound, "_na").join(count_(lore, "_nb"), "category").where("_na > 1 or _nb > 1"))
    cells = wide.agg(F.sum(F.col("_na").cast("long") * F.col("_nb"))).first()[0] or 0
    spark = characters.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions", "200")), min(2 * cells, 20_000))
    own = lambda n: F.pmod(F.xxhash64("_row"), F.coalesce(n, F.lit(1))).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.coalesce(n, F.lit(1)) - 1))
    a = bound.join(F.broadcast(wide), "category", "left").withColumn("_row", F.col("character_id")).withColumn("_a", own(F.col("_na"))).withColumn("_b", every(F.col("_nb")))
    row = F.struct(*[F.col(f"`{c}`") for c in lore.columns])
    b = lore.join(F.broadcast(wide), "category", "left").withColumn("_row", row).withColumn("_b", own(F.col("_nb"))).withColumn("_a", every(F.col("_na")))
    deal = lambda df: df.drop("_na", "_nb", "_row").repartition(parts, "category", "_a", "_b")
    return deal(a).hint("merge").join(deal(b), ["category", "_a", "_b"]).drop("_a", "_b")


def order_lore(lore: DataFrame, keys: list[str]) -> DataFrame:
    """Rank by the first number in title and content; entries without one last, in their own order."""
    code = F.expr("try_cast(regexp_extract(concat_ws(' ', coalesce(title, ''), coalesce(content, '')), '([0-9]+(?:[.][0-9]+)?)', 1) as double)")
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(code.asc_nulls_last(), "entry_id"))
    return lore.withColumn("rank", rank)


def bind_persona(characters: DataFrame, personas: DataFrame) -> DataFrame:
    """The first persona bound to each character's name."""
    # The first of each name, so that a name that many bear makes no pairs.
    roles = personas.select("persona_id", F.explode("bound_roles").alias("name")).groupBy("name").agg(F.min("persona_id").alias("persona_id"))
    return characters.join(roles, "name").groupBy("character_id").agg(F.min("persona_id").alias("persona_id"))


def newest_first(df: DataFrame, ts: str, keys: list[str], tie: str) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(ts), F.desc(tie)))
    return df.withColumn("rank", rank)


def next_summary_task(tasks: DataFrame) -> DataFrame:
    """The task to run next in each conversation: manual before automatic, chat before book, then the oldest.

    Manual tasks drive out automatic ones of their kind; tasks that repeat count once.
    """
    manual = tasks.where("trigger = 'manual'").select("conversation_key", "kind").distinct().withColumn("_manual", F.lit(True))
    kept = tasks.join(manual, ["conversation_key", "kind"], "left").where("not (trigger = 'auto' and coalesce(_manual, false))").drop("_manual")
    first = kept.groupBy("conversation_key", "kind", "trigger", "start", "end").agg(F.min("created_at").alias("created_at"))
    score = F.when(F.col("kind") == "chat", 2).otherwise(1) + F.when(F.col("trigger") == "manual", 10).otherwise(0)
    order = Window.partitionBy("conversation_key").orderBy(F.desc("score"), "created_at", "start")
    return first.withColumn("score", score).withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")


#: Sections of a prompt in their order.
SECTIONS = ("userPersona", "characterPersona", "worldBook", "bookExcerpt", "bookSummary", "chatRaw", "chatSummary", "otherInstructions")


def estimate_tokens(lines: DataFrame) -> DataFrame:
    """``(prompt_id, line_no, section, text)`` -> tokens of each section; a prompt's sections all have a row."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct("line_no", "text"))), lambda x: x["text"])
    texts = lines.where("coalesce(text, '') <> ''").groupBy("prompt_id", "section").agg(F.array_join(parts, "\n").alias("text"))
    spine = lines.select("prompt_id").distinct().withColumn("section", F.explode(F.array(*map(F.lit, SECTIONS))))
    return spine.join(texts, ["prompt_id", "section"], "left").select("prompt_id", "section", token_estimate(F.col("text")).alias("tokens"))


def assemble_context(cards: DataFrame, excerpts: DataFrame, chunks: DataFrame, snippets: DataFrame | None = None) -> DataFrame:
    """For each owner: its cards in order, the excerpt, highlighted snippets, and chunk texts set apart by a rule.

    Where ``cards`` has a safe_offset, cards that end beyond it are left out. What is gathered is one owner's own.
    """
    in_order = lambda key, col: F.transform(F.array_sort(F.collect_list(F.struct(*key, col))), lambda x: x[col])
    if "safe_offset" in cards.columns:
        cards = cards.where(F.col("end") <= F.col("safe_offset"))
    c = cards.groupBy("owner_id").agg(F.array_join(in_order(["start", "end", "card_id"], "content"), "\n").alias("cards"))
    k = chunks.groupBy("owner_id").agg(F.array_join(in_order(["rank"], "text"), "\n---\n").alias("passages"))
    met = c.join(excerpts.select("owner_id", "excerpt"), "owner_id", "full_outer").join(k, "owner_id", "full_outer")
    parts = ["cards", "excerpt", "passages"]
    if snippets is not None:
        said = snippets.where("coalesce(snippet, '') <> ''").groupBy("owner_id").agg(F.array_join(in_order(["start", "range_id"], "snippet"), "\n").alias("snippets"))
        met, parts = met.join(said, "owner_id", "full_outer"), ["cards", "excerpt", "snippets", "passages"]
    return met.select("owner_id", F.concat_ws("\n\n", *[F.nullif(p, F.lit("")) for p in parts]).alias("context"))


def export_transcripts(messages: DataFrame, header: str = "Conversation") -> DataFrame:
    """One text for each conversation: a header, then ``name (time):``, content and a quote of 200 characters at most."""
    quote = F.when(F.coalesce("quote", F.lit("")) != "", F.concat(F.lit("\n> "), F.substring("quote", 1, 200))).otherwise("")
    entry = F.concat(F.col("sender"), F.lit(" ("), minute_stamp(F.col("ts")), F.lit("):\n"), F.col("content"), quote)
    # A conversation is one file, so its messages come together; rows are bounded by the conversation.
    lines = F.transform(F.array_sort(F.collect_list(F.struct("ts", "id", entry.alias("e")))), lambda m: m["e"])
    return messages.groupBy("conversation_key").agg(F.concat(F.lit(header + " "), F.first("conversation_key").cast("string"), F.lit("\n\n"), F.array_join(lines, "\n\n")).alias("text"))


