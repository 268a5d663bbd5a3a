"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks.

Each source's documents are dealt by a seeded hash into shards of about ``shard_tokens`` words and
laid end to end there; every ``block_tokens`` words are a block. Blocks are seats: first the
sources, then the shards inside a source, get integer quotas by the highest quotients
``votes / (2k + 1)``. Inside a shard the quota is drawn by seeded systematic selection over the
block numbers, so what a document gives follows from its offset alone and no block becomes a row.

Nulls, ties, odd rows: a null text has size 0 and gives 0 words; a null source is a source of its
own, ordered last; a null or repeated doc_id is an ordinary row (one result row per input row);
equal quotients go to the smaller party key. An empty table gives an empty result. Only ``doc_id``,
``text`` and ``source`` are read, so extra columns cannot clash.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from onsetlab.llm.text import WORD, attach, text_key, word_count
from onsetlab.staging import broadcast_if_small, staged

CYCLE = (5.0, 2.0, 1.0)
BLOCK_TOKENS = 32
SHARD_TOKENS = 1 << 20
SHARD_ROWS = 1 << 15


def sainte_lague(parties: DataFrame, group: list[str], party: list[str], votes: str, seats: str) -> DataFrame:
    """Add ``quota``: the party's seats among ``seats`` of its group, by the highest quotients votes / (2k + 1).

    A divisor that surely gives too few seats is jumped to first; only the few quotients that can
    still win, 2 to 3 for each party, become rows and are ranked.
    """
    whole = Window.partitionBy(*group)
    v, n = F.sum(votes).over(whole), F.count("*").over(whole)
    low = F.greatest(F.col(seats) - F.ceil(n / 2), F.lit(0))
    some = F.when(F.col(votes) > 0, F.col(votes))
    base = F.coalesce(F.greatest(F.ceil(F.try_divide(some * low, v) - 0.5), F.lit(0)), F.lit(0)).cast("long")
    more = F.coalesce(F.ceil(F.try_divide(some * (n + 1), v)) + 1, F.lit(0)).cast("int")
    begun = parties.withColumn("_base", base).withColumn("_more", more)
    begun = begun.withColumn("_left", F.col(seats) - F.sum("_base").over(whole))
    tried = begun.filter("_more > 0 and _left > 0").withColumn("_k", F.explode(F.sequence(F.lit(0), F.col("_more") - 1)))
    quotient = F.col(votes) / (2 * (F.col("_base") + F.col("_k")) + 1)
    best = Window.partitionBy(*group).orderBy(quotient.desc(), *party, "_k")
    won = tried.withColumn("_rank", F.row_number().over(best)).filter("_rank <= _left")
    keys = list(dict.fromkeys(group + party))
    won = won.groupBy(*keys).agg(F.count("*").alias("_won"))
    return (
        begun.join(won, keys, "left")
        .withColumn("quota", F.col("_base") + F.coalesce(F.col("_won"), F.lit(0)))
        .drop("_base", "_more", "_left", "_won")
    )


def capped_targets(sources: DataFrame, total_share: float, cap_share: float) -> DataFrame:
    """Add ``target``: ``total_share`` of all sizes dealt by weight, none above ``cap_share`` of its own size.

    Sources in the order of cap / weight are capped from the front; the rest share what remains by
    weight, which is what sharing the excess again and again ends in.
    """
    every = Window.partitionBy(F.lit(0))
    order = Window.partitionBy(F.lit(0)).orderBy("_ratio", "source_key")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    level = F.try_divide(
        F.col("_total") - F.coalesce(F.sum("_cap").over(before), F.lit(0.0)),
        F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)),
    )
    out = (
        sources.withColumn("_cap", F.col("source_size") * F.lit(cap_share))
        .withColumn("_ratio", F.col("_cap") / F.col("weight"))
        .withColumn("_total", F.sum("source_size").over(every) * F.lit(total_share))
        .withColumn("_level", level)
        .withColumn("_full", (F.col("_ratio") <= F.col("_level")).cast("int"))
        .withColumn("_full", F.min("_full").over(order.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("_level", F.max(F.when(F.col("_full") == 0, F.col("_level"))).over(every))
    )
    target = F.when(F.col("_full") == 1, F.col("_cap")).otherwise(F.col("weight") * F.col("_level"))
    return out.withColumn("target", target.cast("double")).drop("_cap", "_ratio", "_total", "_level", "_full")


def cyclic_weights(sources: DataFrame, cycle: tuple[float, ...] = CYCLE) -> DataFrame:
    """Weigh sources by their place in code-point order, null last, the cycle repeating."""
    order = Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())
    place = (F.row_number().over(order) - 1) % len(cycle) + 1
    return sources.withColumn("weight", F.element_at(F.array(*map(F.lit, cycle)), place))


def seeded(*parts: Column | str) -> Column:
    """A non-negative 60-bit number from an MD5 digest of the parts, which any SQL engine can make, too."""
    text = F.concat_ws(":", *[F.col(p) if isinstance(p, str) else p for p in parts])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")


def _drawn_before(x: Column, block: int) -> Column:
    """Words of the drawn blocks among a shard's first ``x`` words."""
    drawn = lambda k: F.floor((k * F.col("_extra") + F.col("_start")) / F.col("_blocks"))
    k = F.floor(x / block)
    return drawn(k) * block + (x - k * block) * (drawn(k + 1) - drawn(k))


def plan_mix(
    docs: DataFrame,
    weights=cyclic_weights,
    total_share: float = 1.5,
    cap_share: float = 2.0,
    block_tokens: int = BLOCK_TOKENS,
    shard_tokens: int = SHARD_TOKENS,
    seed: int = 17,
) -> DataFrame:
    """One row per document: what the mix takes of it.

    Returns doc_id, text_key, size, source_size, target, taken, and the draw (offset, copies, and
    the shard's blocks, extra and start), from which ``taken_text`` cuts the words themselves.
    ``weights`` maps the table of sources (source, source_size) to the same with ``weight`` > 0. The
    tables of sources and shards hold one row each per source and per ``shard_tokens`` words.
    """
    key = F.when(F.col("source").isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col("source")))
    sizes = staged(
        docs.select("doc_id", "source", text_key("text").alias("text_key"), word_count("text").alias("size"))
        .withColumn("source_key", key),
        "mix-sizes",
    )
    sources = sizes.groupBy("source_key").agg(
        F.first("source").alias("source"), F.sum("size").alias("source_size"), F.count("*").alias("_docs")
    )
    sources = capped_targets(weights(sources), total_share, cap_share)
    seats = F.floor(F.sum("target").over(Window.partitionBy(F.lit(0))) / block_tokens + 0.5)
    sources = sainte_lague(
        sources.withColumn("_all", F.lit(0)).withColumn("_seats", seats), ["_all"], ["source_key"], "target", "_seats"
    )
    shards_of = F.greatest(
        F.ceil(F.col("source_size") / shard_tokens), F.ceil(F.col("_docs") / SHARD_ROWS), F.lit(1)
    )
    sources = staged(
        sources.select("source_key", "source_size", "target", F.col("quota").alias("_quota"), shards_of.alias("_shards")),
        "mix-sources",
    )
    dealt = sizes.join(broadcast_if_small(sources.select("source_key", "_shards")), "source_key").withColumn(
        "shard", F.pmod(seeded(F.lit(seed), "doc_id"), F.col("_shards")).cast("int")
    )
    shards = dealt.groupBy("source_key", "shard").agg(F.sum("size").alias("_votes"))
    shards = shards.join(broadcast_if_small(sources), "source_key")
    shards = sainte_lague(shards, ["source_key"], ["shard"], "_votes", "_quota")
    blocks = F.greatest(F.ceil(F.col("_votes") / block_tokens), F.lit(1))
    shards = (
        shards.withColumn("_blocks", blocks)
        .withColumn("_got", F.least(F.col("quota"), 2 * F.col("_blocks")))
        .withColumn("copies", F.floor(F.col("_got") / F.col("_blocks")))
        .withColumn("_extra", F.col("_got") - F.col("copies") * F.col("_blocks"))
        .withColumn("_start", F.pmod(seeded(F.lit(seed), "source_key", "shard"), F.col("_blocks")))
        .select("source_key", "shard", "source_size", "target", "copies", "_blocks", "_extra", "_start")
    )
    line = Window.partitionBy("source_key", "shard").orderBy(
        seeded(F.lit(seed + 1), "doc_id"), "doc_id", "text_key"
    )
    offset = F.sum("size").over(line.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    laid = dealt.drop("_shards").withColumn("offset", offset)
    mixed = laid.join(staged(shards, "mix-shards"), ["source_key", "shard"])
    drawn = _drawn_before(F.col("offset") + F.col("size"), block_tokens) - _drawn_before(F.col("offset"), block_tokens)
    return mixed.withColumn("taken", (F.col("copies") * F.col("size") + drawn).cast("long"))


def taken_text(docs: DataFrame, block_tokens: int = BLOCK_TOKENS, **options) -> DataFrame:
    """The mixed documents: the columns of ``docs``, one row per copy, each text cut to the taken words.

    A whole copy keeps its text byte for byte; of a drawn copy the words of drawn blocks stay, runs of
    neighbouring words with the space between them, runs joined by a line break. Documents of which
    nothing is taken go. ``n_chars``, where there is one, follows the new text.
    """
    plan = plan_mix(docs, block_tokens=block_tokens, **options)
    draw = ["offset", "size", "copies", "_blocks", "_extra", "_start", "taken"]
    rows = attach(docs, plan, draw).filter("decided.taken > 0")
    fields = rows.schema["row"].dataType.fieldNames()
    flat = rows.select("row.*", F.to_json("decided").alias("__draw"))
    word = re.compile(WORD)

    def cut(text: str, d: dict) -> str:
        kept, runs = [m.span() for m in word.finditer(text)], []
        at, end, first = d["offset"], d["offset"] + d["size"], True
        drawn = lambda k: (k * d["_extra"] + d["_start"]) // d["_blocks"]
        while at < end:
            k = at // block_tokens
            stop = min(end, (k + 1) * block_tokens)
            if drawn(k + 1) > drawn(k):
                a, b = kept[at - d["offset"]][0], kept[stop - 1 - d["offset"]][1]
                if first:
                    runs.append([a, b])
                else:
                    runs[-1][1] = b
                first = False
            else:
                first = True
            at = stop
        return "\n".join(text[a:b] for a, b in runs)

    def copies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            source, texts = [], []
            draws = batch.column(batch.num_columns - 1).to_pylist()
            for i, (text, draw) in enumerate(zip(batch.column("text").to_pylist(), draws, strict=True)):
                d = json.loads(draw)
                made = [text] * d["copies"]
                if d["taken"] > d["copies"] * d["size"]:
                    made.append(cut(text, d))
                source += [i] * len(made)
                texts += made
            out = batch.select(range(batch.num_columns - 1)).take(pa.array(source, pa.int64()))
            out = out.set_column(fields.index("text"), "text", pa.array(texts, out.schema.field("text").type))
            if "n_chars" in fields:
                kind = out.schema.field("n_chars").type
                out = out.set_column(fields.index("n_chars"), "n_chars", pa.array([len(t) for t in texts], kind))
            yield out

    return flat.mapInArrow(copies, docs.schema)


def query(docs: DataFrame) -> DataFrame:
    return plan_mix(docs).select("doc_id", "size", "source_size", "target", "taken")


def oracle(block_tokens: int = BLOCK_TOKENS, shard_tokens: int = SHARD_TOKENS, shard_rows: int = SHARD_ROWS, seed: int = 17) -> str:
    """The query as DuckDB SQL. Seats are dealt by ranking all quotients that could win one."""
    seeded = lambda *parts: "('0x' || substr(md5(concat_ws(':', " + ", ".join(parts) + ")), 1, 15))::BIGINT"
    drawn = lambda x: (
        f"((({x} // {block_tokens}) * extra + start) // blocks) * {block_tokens} + ({x} % {block_tokens}) * "
        f"(((({x} // {block_tokens}) + 1) * extra + start) // blocks - (({x} // {block_tokens}) * extra + start) // blocks)"
    )
    return rf"""
WITH d AS (
  SELECT doc_id, CASE WHEN source IS NULL THEN '' ELSE '=' || source END AS sk, source,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents
), s0 AS (
  SELECT sk, any_value(source) AS source, sum(size)::BIGINT AS ss, count(*) AS docs FROM d GROUP BY sk
), s1 AS (
  SELECT *, [5.0, 2.0, 1.0][(row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1]::DOUBLE AS w FROM s0
), s2 AS (
  SELECT *, ss * 2.0::DOUBLE AS cap, ss * 2.0::DOUBLE / w AS ratio, sum(ss) OVER () * 1.5::DOUBLE AS total, sum(w) OVER () AS ws FROM s1
), s3 AS (
  SELECT *, (total - coalesce(sum(cap) OVER o, 0)) / nullif(ws - coalesce(sum(w) OVER o, 0), 0) AS lvl FROM s2
  WINDOW o AS (ORDER BY ratio, sk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), s4 AS (
  SELECT *, min((ratio <= lvl)::INT) OVER (ORDER BY ratio, sk ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS is_full FROM s3
), s5 AS (
  SELECT *, CASE WHEN is_full = 1 THEN cap ELSE w * max(CASE WHEN is_full = 0 THEN lvl END) OVER () END AS target FROM s4
), s6 AS (
  SELECT *, sum(target) OVER () AS v, count(*) OVER () AS n, floor(sum(target) OVER () / {block_tokens} + 0.5)::BIGINT AS seats,
         greatest(ceil(ss / {shard_tokens}.0), ceil(docs / {shard_rows}.0), 1)::BIGINT AS shards FROM s5
), c1 AS (
  SELECT sk, seats, row_number() OVER (ORDER BY target / (2 * k + 1) DESC, sk, k) AS rank
  FROM (SELECT *, unnest(range(0, ceil(target * (seats + n) / v)::BIGINT + 2)) AS k FROM s6 WHERE target > 0)
), s7 AS (
  SELECT s6.*, coalesce(won, 0) AS quota FROM s6 LEFT JOIN (SELECT sk, count(*) AS won FROM c1 WHERE rank <= seats GROUP BY sk) USING (sk)
), dealt AS (
  SELECT d.*, {seeded(str(seed), "doc_id")} % shards AS shard FROM d JOIN s7 USING (sk)
), h0 AS (
  SELECT sk, shard, sum(size)::BIGINT AS votes FROM dealt GROUP BY sk, shard
), h1 AS (
  SELECT h0.*, s7.ss, s7.target, s7.quota, sum(votes) OVER (PARTITION BY sk) AS v, count(*) OVER (PARTITION BY sk) AS n FROM h0 JOIN s7 USING (sk)
), c2 AS (
  SELECT sk, shard, quota, row_number() OVER (PARTITION BY sk ORDER BY votes / (2 * k + 1) DESC, shard, k) AS rank
  FROM (SELECT *, unnest(range(0, ceil(votes * (quota + n) / v)::BIGINT + 2)) AS k FROM h1 WHERE votes > 0)
), h2 AS (
  SELECT h1.*, greatest((votes + {block_tokens - 1}) // {block_tokens}, 1) AS blocks, coalesce(won, 0) AS won FROM h1
  LEFT JOIN (SELECT sk, shard, count(*) AS won FROM c2 WHERE rank <= quota GROUP BY sk, shard) USING (sk, shard)
), h3 AS (
  SELECT sk, shard, ss, target, blocks, least(won, 2 * blocks) // blocks AS copies, least(won, 2 * blocks) % blocks AS extra,
         {seeded(str(seed), "sk", "shard")} % blocks AS start FROM h2
), laid AS (
  SELECT *, (sum(size) OVER (PARTITION BY sk, shard ORDER BY {seeded(str(seed + 1), "doc_id")}, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size)::BIGINT AS a FROM dealt
), b AS (
  SELECT *, a + size AS z FROM laid JOIN h3 USING (sk, shard)
)
SELECT doc_id, size, ss AS source_size, target, (copies * size + {drawn("z")} - ({drawn("a")}))::BIGINT AS taken FROM b
"""
