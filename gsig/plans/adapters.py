"""Domain views over the given tables: each as a DataFrame and as SQL."""

from __future__ import annotations

import re
import string

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from ..operators import physical
from ..operators.reads import pieces

LETTERS = string.ascii_lowercase + string.ascii_uppercase
BASES = ("ACGT" * 7)[:26] * 2
READ, CHUNK = 101, 4096
EPOCH = "1995-01-01"


TO_BASES = bytes(BASES[LETTERS.index(chr(i))].encode()[0] if chr(i) in LETTERS else ord("N") for i in range(256))
#: All bytes of a character but its first.
INNER = bytes(range(0x80, 0xC0))
#: So many bytes are mapped at a time.
STEP = 1 << 20


def as_bases(text: Column) -> Column:
    """Letters as ACGT in turn, every other character as N; the length stays. translate() of Spark looks every character up in a map.

    The bytes of a batch are mapped some at a time, so no text becomes an object, and a batch is held twice at most: as it came and as it
    goes. Told as not deterministic, the function is not copied into filters on its result, where Spark would call it again.
    """

    @F.arrow_udf("string")
    def mapped(texts: pa.Array) -> pa.Array:
        valid, offsets, data = texts.buffers()
        wide = np.int64 if pa.types.is_large_string(texts.type) else np.int32
        first, last = np.frombuffer(offsets, wide)[[texts.offset, texts.offset + len(texts)]] if len(texts) else (0, 0)
        ends = np.zeros(texts.offset + len(texts) + 1, wide)
        np.cumsum(pc.fill_null(pc.utf8_length(texts), 0).to_numpy(zero_copy_only=False), out=ends[texts.offset + 1 :])
        bases, done = np.empty(ends[-1], np.uint8), 0
        for at in range(first, last, STEP):
            some = np.frombuffer(data.slice(at, min(STEP, last - at)).to_pybytes().translate(TO_BASES, INNER), np.uint8)
            bases[done : done + len(some)] = some
            done += len(some)
        return pa.Array.from_buffers(texts.type, len(texts), [valid, pa.py_buffer(ends), pa.py_buffer(bases)], offset=texts.offset)

    return mapped.asNondeterministic()(text)


def genome(t) -> DataFrame:
    """contig, seq: one contig per document, its whole text."""
    return t.documents.select(F.col("doc_id").alias("contig"), as_bases(F.col("text")).alias("seq"))


def genome_parts(t, overlap: int, size: int = 512) -> DataFrame:
    """contig, seq: contigs cut into parts, each with the first `overlap` bases of the next, before they become bases: a batch is small."""
    cut = t.documents.select(F.col("doc_id").alias("contig"), pieces(F.col("text"), size).alias("parts"))
    halo = F.transform("parts", lambda x, i: F.concat(x, F.coalesce(F.left(F.get("parts", i + 1), F.lit(overlap)), F.lit(""))))
    return cut.select("contig", F.explode(halo).alias("text")).select("contig", as_bases(F.col("text")).alias("seq"))


def reads(t) -> DataFrame:
    """read_id, sample, seq: whole texts cut into reads. Only then they become bases, so a batch of them is small, however long texts are."""
    cut = t.documents.select("doc_id", F.col("source").alias("sample"), F.posexplode(pieces(F.col("text"), READ)).alias("k", "text"))
    return cut.select((F.col("doc_id") * 1_000_000 + F.col("k")).cast("long").alias("read_id"), "sample", as_bases(F.col("text")).alias("seq"))


def _day(c: str) -> Column:
    return F.datediff(F.to_date(c), F.to_date(F.lit(EPOCH))).cast("long")


def alignments(t) -> DataFrame:
    """qname, flag, contig, sample, start, end, mapq, is_reverse, tlen: one row per line item."""
    j = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
    a, b = _day("o_orderdate"), _day("l_shipdate")
    reverse = b < a
    j = j.select(F.col("l_orderkey").alias("qname"), F.when(F.col("l_linenumber") % 2 == 0, 147).otherwise(99).alias("flag"), F.col("l_linestatus").alias("contig"), F.col("l_returnflag").alias("sample"), F.least(a, b).alias("start"), F.greatest(a, b).alias("end"), F.col("l_quantity").cast("int").alias("mapq"), reverse.alias("is_reverse"))
    return j.withColumn("tlen", F.when(F.col("is_reverse"), F.col("start") - F.col("end")).otherwise(F.col("end") - F.col("start")))


def fragments(t) -> DataFrame:
    return alignments(t).select("sample", "contig", "start", "end", "mapq", "is_reverse")


def bins(t) -> DataFrame:
    """contig, pos, ip_count, ctrl_count."""
    pos = F.floor(F.col("l_partkey") / 10).alias("pos")
    return t.lineitem.groupBy(F.col("l_linestatus").alias("contig"), pos).agg(F.count_if(F.col("l_returnflag") == "R").alias("ip_count"), F.count_if(F.col("l_returnflag") == "A").alias("ctrl_count"))


def signal(t) -> DataFrame:
    """contig, pos, value: the events of a type in order of their id; values in hundredths so that sums are exact."""
    e = t.events.select(F.col("event_type").alias("contig"), "event_id", "value", F.lit(1).alias("_n"))
    e, _ = physical.ranked_counts(e, ["contig"], "event_id")
    return e.select("contig", (F.col("_upto") - 1).cast("long").alias("pos"), F.round(F.col("value") * 100).alias("value"))


def tracks(t) -> DataFrame:
    """track, contig, pos, value: quantity by part, one track per return flag; whole numbers."""
    return t.lineitem.groupBy(F.col("l_returnflag").alias("track"), F.col("l_linestatus").alias("contig"), F.col("l_partkey").alias("pos")).agg(F.sum("l_quantity").alias("value"))


def intervals_a(t) -> DataFrame:
    d = _day("o_orderdate")
    return t.orders.select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("contig"), d.alias("start"), (d + 1 + F.col("o_custkey") % 30).alias("end"), F.length("o_orderpriority").alias("score"))


def intervals_b(t) -> DataFrame:
    d = _day("l_shipdate")
    return t.lineitem.select(F.when(F.col("l_linestatus") == "O", "O").otherwise("F").alias("contig"), d.alias("start"), (d + 1 + F.col("l_partkey") % 20).alias("end")).distinct()


def preds(t) -> DataFrame:
    """id, label, pred."""
    j = t.labels.select("doc_id", "quality")
    return j.select(F.col("doc_id").alias("id"), (F.col("quality") == 1).alias("label"), ((F.col("doc_id") * 7919 % 1000).cast("double") / F.lit(1000.0)).alias("pred"))


def contrib(t) -> DataFrame:
    """contig, win_start, grads."""
    return t.embeddings.select(F.col("label").alias("contig"), F.col("vec_id").alias("win_start"), F.col("embedding").alias("grads"))


_DAY = f"cast(date_diff('day', date '{EPOCH}', cast({{}} as date)) as bigint)"
_SEQ = f"regexp_replace(translate(text, '{LETTERS}', '{BASES}'), '[^ACGT]', 'N', 'g')"
VIEWS = {
    "genome": f"select doc_id as contig, {_SEQ} as seq from documents",
    "reads": f"select doc_id * 1000000 + k as read_id, source as sample, substring(s, cast(k * {READ} + 1 as bigint), {READ}) as seq from (select doc_id, source, {_SEQ} as s, unnest(range(0, greatest(1, (length(text) + {READ - 1}) // {READ}))) as k from documents)",
    "alignments": f"""select *, case when is_reverse then start - "end" else "end" - start end as tlen from (select l_orderkey as qname, case when l_linenumber % 2 = 0 then 147 else 99 end as flag, l_linestatus as contig, l_returnflag as sample, least(a, b) as start, greatest(a, b) as "end", cast(l_quantity as integer) as mapq, b < a as is_reverse
        from (select *, {_DAY.format("o_orderdate")} as a, {_DAY.format("l_shipdate")} as b from lineitem join orders on l_orderkey = o_orderkey))""",
    "fragments": 'select sample, contig, start, "end", mapq, is_reverse from alignments',
    "bins": "select l_linestatus as contig, l_partkey // 10 as pos, count(*) filter (l_returnflag = 'R') as ip_count, count(*) filter (l_returnflag = 'A') as ctrl_count from lineitem group by 1, 2",
    "signal": "select event_type as contig, row_number() over (partition by event_type order by event_id) - 1 as pos, round(value * 100) as value from events",
    "tracks": "select l_returnflag as track, l_linestatus as contig, l_partkey as pos, sum(l_quantity) as value from lineitem group by 1, 2, 3",
    "intervals_a": f"""select o_orderkey as id, o_orderstatus as contig, {_DAY.format("o_orderdate")} as start, {_DAY.format("o_orderdate")} + 1 + o_custkey % 30 as "end", cast(length(o_orderpriority) as integer) as score from orders""",
    "intervals_b": f"""select distinct case when l_linestatus = 'O' then 'O' else 'F' end as contig, {_DAY.format("l_shipdate")} as start, {_DAY.format("l_shipdate")} + 1 + l_partkey % 20 as "end" from lineitem""",
    "preds": "select doc_id as id, quality = 1 as label, cast(doc_id * 7919 % 1000 as double) / 1000 as pred from labels",
    "contrib": "select label as contig, vec_id as win_start, embedding as grads from embeddings",
}


def with_views(sql: str) -> str:
    """sql after the definitions of the views that it names, directly or through another."""
    named: set[str] = set()

    def visit(text: str) -> None:
        for v in VIEWS:
            if v not in named and re.search(rf"\b(?:from|join)\s+{v}\b|, {v} \b", text):
                named.add(v)
                visit(VIEWS[v])

    visit(sql)
    ctes = [f"{v} as ({VIEWS[v]})" for v in ("alignments", *(x for x in VIEWS if x != "alignments")) if v in named]
    if not ctes:
        return sql
    body = sql.strip()
    if body.lower().startswith("with recursive "):
        return f"with recursive {', '.join(ctes)}, {body[15:]}"
    if body.lower().startswith("with "):
        return f"with {', '.join(ctes)}, {body[5:]}"
    return f"with {', '.join(ctes)} {body}"
