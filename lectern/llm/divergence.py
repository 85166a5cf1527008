"""How the sources of a language differ in their words.

Texts are counted where they are read, and only (language, source, term) counts are
shuffled, by (language, term), so a source that holds a third of all documents is no
larger a key than any other.

The words that tell a source best are found by dominance.  A word that is at least as
common in the source, at most as common in the language and earlier in UTF-8 than another
ranks before it, whatever the totals are.  So every partition keeps the words of a source
that fewer than k others dominate (its skyband), skybands are merged, and only what is
left is valued and ranked.

Two sources are compared over all words in blocks: some 4096 words by 512 sources against
512, as a matrix; only sums per pair leave a block.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from lectern.llm.common import whole_text
from lectern.session import materialize

#: Least documents of a kept term, and terms ranked per source.
MIN_DOCUMENTS, TOP_TERMS = 10, 10
SCALE = 1_000_000_000
#: Words and sources of a block of the comparison.
BLOCK_TERMS, BLOCK_SOURCES = 4096, 512
#: Counts a task gathers before it passes them on.
HELD_COUNTS = 500_000
#: Rows of a source after which its skyband is found, to go on with it alone.
HELD_ROWS = 20_000
#: Parts in which the skybands of a source are merged first.
MERGE_PARTS = 16

#: Every byte that is no part of a term becomes a blank; A-Z become a-z.
_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)
COUNTED = "lang string, source string, term string, count long, documents long"


def terms(text: str) -> list[bytes]:
    return text.encode().translate(_BYTES).split()


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences and documents of every term per (lang, source); a null term stands for the group itself."""
    groups: dict[tuple[str, str], tuple[Counter, Counter]] = defaultdict(lambda: (Counter(), Counter()))

    def found() -> pa.RecordBatch:
        rows: list[list] = [[], [], [], [], []]
        for (lang, source), (count, documents) in groups.items():
            names = [*count, None]
            for column, values in zip(
                rows, ([lang] * len(names), [source] * len(names), names, [*count.values(), 0], [*map(documents.get, count), 0])
            ):
                column += values
        groups.clear()
        kinds = [pa.string(), pa.string(), pa.binary(), pa.int64(), pa.int64()]
        columns = [pa.array(values, kind) for values, kind in zip(rows, kinds)]
        columns[2] = columns[2].cast(pa.string())
        return pa.RecordBatch.from_arrays(columns, names=["lang", "source", "term", "count", "documents"])

    held = 0
    for batch in batches:
        for lang, source, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
            words = terms(text)
            count, documents = groups[lang, source]
            held -= len(count)
            count.update(words)
            documents.update(set(words))
            held += len(count)
            if held > HELD_COUNTS:
                yield found()
                held = 0
    yield found()


def term_counts(docs: DataFrame, min_documents: int = MIN_DOCUMENTS) -> DataFrame:
    """Kept terms: lang, term, total, sources (source, count of those that hold it), written once.

    One more row per language, with null term, lists all its sources.
    """
    read = docs.select(whole_text("lang").alias("lang"), whole_text("source").alias("source"), whole_text().alias("text"))
    counted = read.mapInArrow(_count, COUNTED)
    # Dealt by (lang, term), both sums stay in place.
    per_source = (
        counted.repartition("lang", "term")
        .groupBy("lang", "term", "source")
        .agg(F.sum("count").alias("count"), F.sum("documents").alias("documents"))
    )
    kept = per_source.groupBy("lang", "term").agg(
        F.sum("count").alias("total"),
        F.sum("documents").alias("documents"),
        F.collect_list(F.struct("source", "count")).alias("sources"),
    )
    return materialize(kept.where(F.col("term").isNull() | (F.col("documents") >= min_documents)).drop("documents"))


def _probability(count: Column, n: Column, v: Column) -> Column:
    """``1 + floor(SCALE * (count + 2) / (n + 2 v))``, exact beyond 64 bits."""
    whole = lambda c: c.cast("decimal(27,0)")
    top = F.lit(SCALE).cast("decimal(10,0)") * whole(count + 2)
    return F.call_function("div", top, whole(n + 2 * v)).cast("bigint") + 1


def _divergence(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def group_totals(kept: DataFrame) -> DataFrame:
    """lang, source, n (occurrences of kept terms), v and lang_n (terms and occurrences of the language), written once."""
    spread = kept.select("lang", F.explode("sources").alias("at")).select("lang", "at.source", "at.count")
    per_group = spread.groupBy("lang", "source").agg(F.sum("count").alias("n"))
    per_lang = kept.groupBy("lang").agg(
        F.count("term").alias("v"), F.coalesce(F.sum(F.when(F.col("term").isNotNull(), F.col("total"))), F.lit(0)).alias("lang_n")
    )
    return materialize(per_group.join(per_lang, "lang"))


# -- Words of a source ------------------------------------------------------------------


def skyband(counts: np.ndarray, totals: np.ndarray, names: list[bytes], k: int) -> np.ndarray:
    """Places of the rows that fewer than ``k`` others dominate.

    A row dominates another with at most its count, at least its total and a later name.
    It is enough to look among rows found so far: of the dominators of a row the first k
    in this order are dominated by fewer than k themselves.
    """
    rank = np.empty(len(names), np.int64)
    rank[sorted(range(len(names)), key=names.__getitem__)] = np.arange(len(names))
    order = np.lexsort((rank, totals, -counts))
    kept: list[int] = []
    step = 256
    for start in range(0, len(order), step):
        block = order[start : start + step]
        if kept:
            before = np.array(kept)
            beaten = ((totals[before] <= totals[block, None]) & (rank[before] < rank[block, None])).sum(1)
        else:
            beaten = np.zeros(len(block), np.int64)
        inside = (totals[block] <= totals[block, None]) & (rank[block] < rank[block, None])
        good: list[int] = []
        for i in np.flatnonzero(beaten < k):
            if beaten[i] + inside[i, good].sum() < k:
                good.append(int(i))
        kept += block[good].tolist()
    return np.array(kept, np.int64)


def _skybands(k: int):
    """Keep the skyband of every (lang, source); rows come sorted by them, and one source is held at a time."""

    def thin(rows: pa.Table) -> pa.Table:
        term = rows["term"].cast(pa.binary()).to_pylist()
        return rows.take(pa.array(np.sort(skyband(rows["count"].to_numpy(), rows["total"].to_numpy(), term, k))))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, key, limit = [], None, HELD_ROWS
        for batch in batches:
            keys = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
            ends = [i for i in range(1, len(keys)) if keys[i] != keys[i - 1]] + [len(keys)]
            start = 0
            for end in ends if keys else ():
                if held and keys[start] != key:
                    yield from thin(pa.Table.from_batches(held)).to_batches()
                    held, limit = [], HELD_ROWS
                key = keys[start]
                held.append(batch.slice(start, end - start))
                start = end
                if sum(map(len, held)) > limit:
                    held = thin(pa.Table.from_batches(held)).combine_chunks().to_batches()
                    # Twice what is left, so that every row is compared a bounded number of times.
                    limit = max(HELD_ROWS, 2 * sum(map(len, held)))
        if held:
            yield from thin(pa.Table.from_batches(held)).to_batches()

    return keep


def telling_terms(kept: DataFrame, groups: DataFrame, top: int = TOP_TERMS) -> DataFrame:
    """The ``top`` terms of every source that it uses more than its language does, by divergence."""
    shape = "lang string, source string, term string, count long, total long"
    spread = kept.where("term IS NOT NULL").select("lang", "term", "total", F.explode("sources").alias("at"))
    rows = spread.select("lang", "at.source", "term", "at.count", "total").where("count > 0")
    local = rows.sortWithinPartitions("lang", "source").mapInArrow(_skybands(top), shape)
    dealt = local.repartition("lang", "source", F.pmod(F.xxhash64("term"), F.lit(MERGE_PARTS)))
    merged = dealt.sortWithinPartitions("lang", "source").mapInArrow(_skybands(top), shape)
    p = _probability(F.col("count"), F.col("n"), F.col("v"))
    q = _probability(F.col("total"), F.col("lang_n"), F.col("v"))
    valued = (
        merged.join(groups, ["lang", "source"])
        .select("lang", "source", "term", p.alias("p"), q.alias("q"))
        .where("p > q")
        .select("lang", "source", F.col("term").alias("item"), _divergence(F.col("p"), F.col("q")).alias("value"))
    )
    by_value = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return valued.withColumn("rank", F.row_number().over(by_value)).where(F.col("rank") <= top)


# -- Pairs of sources -------------------------------------------------------------------


def _compare(key, terms_: pa.Table, groups: pa.Table) -> pa.Table:
    """Sums of divergence over the terms of one block, between the sources of two tiles."""
    lang, tile, other = key[0].as_py(), key[2].as_py(), key[3].as_py()
    base = groups["base"].to_numpy()
    place, names = groups["place"].to_numpy(), groups["source"].to_pylist()
    column = {int(p): i for i, p in enumerate(place)}
    n_terms = int(terms_["row"].to_numpy().max()) + 1 if len(terms_) else 0
    p = np.repeat(base[None, :], n_terms, 0)
    if n_terms:
        at = np.array([column[x] for x in terms_["cell"].to_pylist()], np.int64)
        p[terms_["row"].to_numpy(), at] = terms_["p"].to_numpy()
    tiles = groups["home"].to_numpy()
    one, two = np.flatnonzero(tiles == tile), np.flatnonzero(tiles == other)
    out: tuple[list, list, list] = ([], [], [])
    for a in one:
        pair = two[place[two] > place[a]] if tile == other else two
        if not len(pair):
            continue
        difference = p[:, a, None] - p[:, pair]
        sums = (difference * difference // (p[:, a, None] + p[:, pair])).sum(0, dtype=np.int64)
        out[0].extend([names[a]] * len(pair))
        out[1].extend(names[b] for b in pair)
        out[2].extend(sums.tolist())
    return pa.table(
        {"lang": pa.array([lang] * len(out[0]), pa.string()), "one": pa.array(out[0], pa.string()),
         "two": pa.array(out[1], pa.string()), "value": pa.array(out[2], pa.int64())}
    )


def source_pairs(
    kept: DataFrame, groups: DataFrame, block_terms: int = BLOCK_TERMS, block_sources: int = BLOCK_SOURCES
) -> DataFrame:
    """Every source against every other of its language: summed divergence over all kept terms, ranked."""
    by_name = Window.partitionBy("lang").orderBy("source")
    placed = materialize(
        groups.select(
            "lang", "source", "n", "v",
            (F.row_number().over(by_name) - 1).cast("bigint").alias("place"),
            F.count("*").over(Window.partitionBy("lang")).alias("n_sources"),
        ).withColumns(
            {
                # What a term that the source lacks is given.
                "base": F.when(F.col("v") > 0, _probability(F.lit(0), F.col("n"), F.col("v"))).otherwise(F.lit(1)),
                "blocks": F.greatest(F.ceil(F.col("v") / block_terms), F.lit(1)),
                "tiles": F.ceil(F.col("n_sources") / block_sources),
            }
        )
    )

    def met(tile: Column) -> Column:
        """The pairs of tiles that a tile takes part in."""
        every = F.sequence(F.lit(0).cast("bigint"), F.col("tiles") - 1)
        return F.transform(every, lambda o: F.struct(F.least(tile, o).alias("tile"), F.greatest(tile, o).alias("other")))

    tile = F.call_function("div", F.col("place"), F.lit(block_sources))
    # A tile meets itself in one pair, and everything of it goes to each pair it takes part in.
    sides = placed.select(
        "lang", "source", "place", "base", tile.alias("home"), F.explode(met(tile)).alias("at"),
        F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1).alias("every"),
    ).select("lang", F.explode("every").alias("block"), "at.tile", "at.other", "home", "source", "place", "base")

    spread = kept.where("term IS NOT NULL").select("lang", "term", F.explode("sources").alias("at"))
    valued = spread.select("lang", "term", "at.source", "at.count").join(placed, ["lang", "source"])
    block = F.pmod(F.xxhash64("term"), F.col("blocks"))
    cells = valued.select(
        "lang", block.alias("block"), "term", F.col("place").alias("cell"), _probability(F.col("count"), F.col("n"), F.col("v")).alias("p"),
        F.explode(met(tile)).alias("at"),
    ).select("lang", "block", "at.tile", "at.other", "term", "cell", "p")

    def compare(key, left: pa.Table, right: pa.Table) -> pa.Table:
        rows = left["term"].combine_chunks().dictionary_encode() if len(left) else None
        numbers = rows.indices.cast(pa.int64()) if rows is not None else pa.array([], pa.int64())
        return _compare(key, left.append_column("row", numbers), right)

    keys = ["lang", "block", "tile", "other"]
    sums = (
        cells.groupBy(*keys)
        .cogroup(sides.groupBy(*keys))
        .applyInArrow(compare, "lang string, one string, two string, value long")
        .groupBy("lang", "one", "two")
        .agg(F.sum("value").alias("value"))
    )
    both = F.explode(F.array(F.struct(F.col("one").alias("source"), F.col("two").alias("item")), F.struct(F.col("two").alias("source"), F.col("one").alias("item"))))
    by_value = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return sums.select("lang", both.alias("at"), "value").select("lang", "at.source", "at.item", "value").withColumn("rank", F.row_number().over(by_value))


def audit(docs: DataFrame, min_documents: int = MIN_DOCUMENTS, top: int = TOP_TERMS) -> DataFrame:
    """Part ``pair`` of :func:`source_pairs` and part ``term`` of :func:`telling_terms` of ``docs``.

    ``docs`` has text, lang and source; other columns are left out.  Nulls are empty texts
    and names; rows that repeat count each; a language whose terms are all rare has pairs
    of value 0 and no terms; a source that is alone has no pairs; no documents give no rows.
    Returns lang, source, part, item, value, rank.
    """
    kept = term_counts(docs, min_documents)
    groups = group_totals(kept)
    columns = ("lang", "source", "part", "item", "value", "rank")
    pairs = source_pairs(kept, groups).withColumn("part", F.lit("pair"))
    told = telling_terms(kept, groups, top).withColumn("part", F.lit("term"))
    return pairs.select(*columns).unionByName(told.select(*columns))
