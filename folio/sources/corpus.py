"""Sources and sinks: text files of unknown charset, lore cards, validated records, archives, transcripts."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.functions.text import compact, normalize_block, strip

#: Charsets in the order in which they are tried.
CHARSETS = ("utf-8", "utf-16-le", "utf-16-be", "gb18030", "gbk")
_BOMS = ((b"\xef\xbb\xbf", "utf-8"), (b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be"))
_CONTROL = {c: None for c in [*range(1, 9), 11, 12, *range(14, 32), 127]}


def decode_best(raw: bytes) -> str:
    """By its byte order mark, else in the charset whose text has the fewest signs of being wrong."""
    for bom, charset in _BOMS:
        if raw.startswith(bom):
            return raw[len(bom) :].decode(charset, "replace")
    best, least = "", None
    for charset in CHARSETS:
        text = raw.decode(charset, "replace")
        bad = 1000 * text.count("�") + 200 * text.count("\0") + 10 * (len(text) - len(text.translate(_CONTROL)))
        if least is None or bad < least:
            best, least = text, bad
        if not least:
            break
    return best


def decode_text(df: DataFrame, keys: list[str], content: str) -> DataFrame:
    """``keys`` and ``text``: binary contents decoded and cleaned."""
    own = df.select(*keys, content)
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in own.schema.fields[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text = pa.array([decode_best(x or b"") for x in b.column(len(keys)).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], text], names=[*keys, "text"])

    return own.mapInArrow(run, f"{kinds}, text string").withColumn("text", normalize_block(F.col("text")))


def read_text_corpus(spark: SparkSession, path: str) -> DataFrame:
    """``(path, text)`` of each file under a path."""
    return decode_text(spark.read.format("binaryFile").load(path), ["path"], "content")


_ENTRY = "struct<comment:string,content:string,position:string,insertion_order:double,displayIndex:double,order:double>"


def read_lore_cards(df: DataFrame, keys: list[str], col: str = "json") -> DataFrame:
    """Entries of character cards (an array under data.character_book) and of lore files (an object of entries), in order.

    Text that is not JSON gives no rows. Positions before_char and 0 are BEFORE, all others AFTER.
    """
    card = F.from_json(col, f"struct<name:string,data:struct<name:string,character_book:struct<entries:array<{_ENTRY}>>>>")
    lore = F.from_json(col, f"struct<name:string,entries:map<string,{_ENTRY}>>")
    parsed = df.select(*keys, card.alias("c"), lore.alias("l"))
    listed = F.coalesce("c.data.character_book.entries", F.array().cast(f"array<{_ENTRY}>"))
    named = F.when(F.col("l.name").isNull(), F.map_values("l.entries"))
    kind = F.when(F.size(listed) > 0, "card").otherwise("lore")
    rows = parsed.select(*keys, kind.alias("kind"), F.coalesce("c.data.name", "c.name").alias("name"), F.posexplode(F.when(F.size(listed) > 0, listed).otherwise(F.coalesce(named, F.array().cast(f"array<{_ENTRY}>")))).alias("i", "e"))
    card_title, lore_title = F.concat(F.lit("条目 "), F.col("i") + 1), F.lit("未命名条目")
    title = F.coalesce("e.comment", F.when(F.col("kind") == "card", card_title).otherwise(lore_title))
    order = F.when(F.col("kind") == "card", F.coalesce("e.insertion_order", F.col("i"))).otherwise(F.coalesce("e.displayIndex", "e.order", F.lit(0.0)))
    place = F.when(F.coalesce("e.position", F.lit("")).isin("before_char", "0"), "BEFORE").otherwise("AFTER")
    return rows.select(*keys, "name", title.alias("title"), F.coalesce("e.content", F.lit("")).alias("content"), place.alias("position"), order.cast("double").alias("sort_order"), F.col("i").alias("entry_index"))


def _number(c: str) -> Column:
    n = F.col(c).try_cast("double")
    return F.when(~F.isnan(n) & (F.abs(n) != float("inf")), n)


def _text(c: str) -> Column:
    return strip(F.coalesce(F.col(c).cast("string"), F.lit("")))


def normalize_cards(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Valid cards with whole, non-negative ranges, and the rows that are not valid."""
    ok = (_text("card_id") != "") & (_text("content") != "") & _number("start").isNotNull() & _number("end").isNotNull()
    start = F.greatest(F.lit(0), F.floor(_number("start")))
    good = df.where(ok).select("owner_id", "card_id", _text("content").alias("content"), start.alias("start"), F.greatest(start, F.floor(_number("end"))).alias("end"))
    return good, df.where(~F.coalesce(ok, F.lit(False)))


def normalize_chapters(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    ok = (_text("title") != "") | (F.coalesce("content", F.lit("")) != "")
    title = F.when(_text("title") == "", F.lit("未命名章节")).otherwise(_text("title"))
    return df.where(ok).select("book_id", "chapter_index", title.alias("title"), F.coalesce("content", F.lit("")).alias("content")), df.where(~ok)


def normalize_blocks(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    ok = F.coalesce(((F.col("type") == "text") & F.col("text").isNotNull()) | ((F.col("type") == "image") & (_text("image_ref") != "")), F.lit(False))
    size = lambda c: F.when(_number(c) > 0, F.round(_number(c)).cast("int")).alias(c)
    rest = [c for c in df.columns if c not in ("width", "height")]
    return df.where(ok).select(*rest, *[size(c) for c in ("width", "height") if c in df.columns]), df.where(~ok)


def normalize_messages(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    ok = F.coalesce(F.col("sender").isin("user", "character") & (compact(F.coalesce("content", F.lit(""))) != ""), F.lit(False))
    return df.where(ok).withColumn("content", compact(F.col("content"))).withColumn("sent_to_ai", F.coalesce("sent_to_ai", F.lit(True))), df.where(~ok)


def normalize_embeddings(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    vector = (F.size("embedding") > 0) & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x))
    ok = F.coalesce((_text("chunk_id") != "") & (_text("book_id") != "") & (F.coalesce("text", F.lit("")) != "") & (F.col("start_offset") >= 0) & (F.col("end_offset") >= F.col("start_offset")) & vector, F.lit(False))
    return df.where(ok), df.where(~ok)


def normalize_index_meta(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    ok = F.coalesce((_text("book_id") != "") & (F.col("chunk_count") >= 0) & (F.col("indexed_up_to") >= 0), F.lit(False))
    return df.where(ok).withColumn("content_signature", F.nullif(_text("content_signature"), F.lit(""))), df.where(~ok)


def normalize_bookmarks(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    ok = F.coalesce((_text("bookmark_id") != "") & (F.col("global_char_offset") >= 0), F.lit(False))
    return df.where(ok), df.where(~ok)


def normalize_buckets(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    ok = F.coalesce(_text("conversation_key") != "", F.lit(False))
    names = {c: compact(F.coalesce(c, F.lit(""))) for c in ("persona_name", "character_name")}
    return df.where(ok).withColumns(names), df.where(~ok)


SCHEMA_NAME, VERSION, APP_ID = "reading-archive", 1, "folio"


def export_archive(spark: SparkSession, tables: dict[str, DataFrame], path: str, exported_at: str, app_id: str = APP_ID) -> None:
    """Each table as Parquet under ``path``, and a manifest that names them and the application; written last, so a broken export has none."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")
    manifest = {"schema": SCHEMA_NAME, "version": VERSION, "exportedAt": exported_at, "appId": app_id, "tables": sorted(tables)}
    spark.createDataFrame([(json.dumps(manifest),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/_manifest")


#: Table of an archive -> the rows that a restore takes, where the table has these columns.
ROW_RULES = {
    "books": "book_id <> ''",
    "images": "image_ref <> '' and data_url like 'data:%'",
    "conversations": "conversation_key <> '' and bucket like '{%'",
    "audio": "audio_key <> '' and audio is not null",
    "settings": "key <> '' and value is not null",
}


def restore_archive(spark: SparkSession, path: str, rules: dict[str, str] | None = None, legacy_key: str = "chat_history", app_id: str = APP_ID) -> dict[str, DataFrame]:
    """The tables of an archive; ValueError if its manifest is missing, foreign, of another application, undated or newer than this code.

    ``rules`` (conditions by table name, ROW_RULES unless given) say which rows are taken; nulls go. Archives of old have
    their chats in ``settings`` (key, value) as one JSON object of buckets by conversation under ``legacy_key``: where
    ``conversations`` (conversation_key, bucket) is missing or has no good row, it is read from there; a broken object
    gives none. The settings come back without that key.
    """
    try:
        manifest = json.loads("".join(r[0] for r in spark.read.text(f"{path}/_manifest").collect()))
    except Exception as e:
        raise ValueError(f"{path} has no readable manifest") from e
    known = isinstance(manifest, dict) and manifest.get("schema") == SCHEMA_NAME and manifest.get("appId") == app_id
    if not known or not isinstance(manifest.get("version"), int) or not 1 <= manifest["version"] <= VERSION or not manifest.get("exportedAt"):
        raise ValueError(f"{path} is not an archive that can be read here")
    out = {}
    for name in manifest["tables"]:
        rule = (ROW_RULES if rules is None else rules).get(name)
        df = spark.read.parquet(f"{path}/{name}")
        out[name] = df.where(rule) if rule else df
    if "settings" in out and {"key", "value"} <= set(out["settings"].columns):
        old = out["settings"].where(F.col("key") == legacy_key)
        out["settings"] = out["settings"].where(~F.col("key").eqNullSafe(legacy_key))
        if "conversations" not in out or out["conversations"].isEmpty():
            buckets = old.select(F.explode(F.from_json("value", "map<string,string>")).alias("conversation_key", "bucket"))
            out["conversations"] = buckets.where(ROW_RULES["conversations"])
    return out


POINTER = "CURRENT"


def _hadoop(spark: SparkSession, path: str):
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(conf)


def _version(spark: SparkSession, path: str) -> str | None:
    """The folder that holds the tables now."""
    at, fs = _hadoop(spark, f"{path}/{POINTER}")
    return spark.read.text(at.toString()).first()[0] if fs.exists(at) else None


def _point(spark: SparkSession, path: str, version: str) -> None:
    """Put the pointer's new text in place of the old one in one step."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    new, fs = _hadoop(spark, f"{path}/.{POINTER}-{version}")
    out = fs.create(new, True)
    out.write(bytearray(version.encode()))
    out.close()
    over = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 1)
    over[0] = getattr(jvm.org.apache.hadoop.fs, "Options$Rename").OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(new.toUri(), conf).rename(new, jvm.org.apache.hadoop.fs.Path(f"{path}/{POINTER}"), over)


def replace_all(tables: dict[str, DataFrame], path: str, known: dict[str, str] | None = None) -> None:
    """Put ``tables`` in place of all that ``path`` holds; tables of ``known`` (name -> schema) that are not given become empty.

    The tables are written to a new folder, and a pointer to it is swapped last, so that until then, and after a failure
    at any table, the old ones can be read whole (``live_tables``). ``tables`` may be read from ``path`` itself.
    The folder before stays for those who still read it; older ones go.
    """
    spark = next((df.sparkSession for df in tables.values()), None) or SparkSession.active()
    before, version = _version(spark, path), f"v-{uuid.uuid4().hex}"
    whole = {n: spark.createDataFrame([], schema) for n, schema in (known or {}).items()} | tables
    for name, df in whole.items():
        df.write.parquet(f"{path}/{version}/{name}")
    manifest = {"schema": SCHEMA_NAME, "version": VERSION, "tables": sorted(whole)}
    spark.createDataFrame([(json.dumps(manifest),)], "value string").coalesce(1).write.text(f"{path}/{version}/_manifest")
    _point(spark, path, version)
    at, fs = _hadoop(spark, path)
    for found in fs.listStatus(at):
        name = found.getPath().getName()
        if name.startswith("v-") and name not in (before, version):
            fs.delete(found.getPath(), True)


def live_tables(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables that the last whole ``replace_all`` has put under ``path``; none before the first."""
    version = _version(spark, path)
    if version is None:
        return {}
    manifest = json.loads(spark.read.text(f"{path}/{version}/_manifest").first()[0])
    return {n: spark.read.parquet(f"{path}/{version}/{n}") for n in manifest["tables"]}


def write_transcripts(transcripts: DataFrame, path: str, folders: bool = False) -> None:
    """Texts by conversation: a JSON line each, in as many files as the table has partitions.

    ``folders`` gives each conversation a folder of its own with its plain text; that is for few conversations, as every one makes a file.
    """
    if folders:
        transcripts.select("conversation_key", F.col("text").alias("value")).write.mode("overwrite").partitionBy("conversation_key").text(path)
    else:
        transcripts.select("conversation_key", "text").write.mode("overwrite").json(path)
