"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests.

A text is the set of its paragraphs, long ones cut into pieces of bounded length.  Each
digest is added to three of the cells of a small sketch; subtracting the sketches of two
versions leaves only digests that differ, and peeling cells that hold a single digest
recovers them.  Where a difference is too large for the sketch, the digests are dealt
over more sketches with fresh hash functions, and only those that still cannot be peeled
are dealt again, until every difference is known exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lectern.llm.common import release, shared_path, whole_text
from lectern.operators.scan import Running, ordered_scan
from lectern.session import materialize

#: Characters of the longest piece of a paragraph.
PIECE = 120
#: A sketch has three rows of cells; each digest goes into one cell of each.
ROWS = 3
#: Cells of a row of the fingerprint itself, and spare room of the larger sketches of a retry.
ROW_CELLS, SPARE = 8, 2
#: Passes over the rows of a sketch before it counts as too small.
PASSES = 2
PAIR = ["row", "side", "width"]
#: The cell that counts recovered digests.
FOUND = -1


def digests(text: Column) -> Column:
    """Distinct digests of the pieces of a text's paragraphs."""
    return F.array_distinct(
        F.transform(F.regexp_extract_all(text, F.lit(f"([^\\n]{{1,{PIECE}}})"), F.lit(1)), lambda p: F.xxhash64(p))
    )


def _check(key: Column) -> Column:
    return F.xxhash64(key, F.lit("check")).bitwiseAND(F.lit(0xFFFFFFFF))


def _entries(key: Column, n: Column, chk: Column, width: Column, seed: int) -> list[Column]:
    """What a digest adds to its cell in each row; cells are numbered through the rows."""
    return [
        F.struct(
            (F.pmod(F.xxhash64(key, F.lit(seed * ROWS + row)), width) + row * width).alias("cell"),
            n.alias("n"), key.alias("key"), chk.alias("chk"),
        )
        for row in range(ROWS)
    ]


def _summed(entries: DataFrame, by: list[str]) -> DataFrame:
    return entries.groupBy(*by, "e.cell").agg(
        F.sum("e.n").alias("n"), F.bit_xor("e.key").alias("key"), F.bit_xor("e.chk").alias("chk")
    )


def sketches(signed_keys: DataFrame, by: list[str], seed: int) -> DataFrame:
    """Cells (cell, n, key, chk) of the signed digests (key, sign) per ``by``, of which ``width`` is one."""
    entries = _entries(F.col("key"), F.col("sign"), _check(F.col("key")), F.col("width"), seed)
    return _summed(signed_keys.select(*by, F.explode(F.array(*entries)).alias("e")), by)


def peel_row(cells: DataFrame, row: int, seed: int) -> DataFrame:
    """Take the digests that are alone in a cell of ``row`` out of all rows and count them.

    A digest is in one cell of the row, so it is taken out once.
    """
    own = F.struct("cell", "n", "key", "chk")
    in_row = (F.col("cell") >= row * F.col("width")) & (F.col("cell") < (row + 1) * F.col("width"))
    alone = in_row & (F.abs("n") == 1) & (F.col("chk") == _check(F.col("key")))
    zero = F.lit(0).cast("long")
    count = F.struct(F.lit(FOUND).cast("long").alias("cell"), F.lit(1).cast("long").alias("n"), zero.alias("key"), zero.alias("chk"))
    taken = F.array(own, count, *_entries(F.col("key"), -F.col("n"), F.col("chk"), F.col("width"), seed))
    empty = (F.col("n") == 0) & (F.col("key") == 0) & (F.col("chk") == 0)
    rows = cells.where(~empty).select(*PAIR, F.explode(F.when(alone, taken).otherwise(F.array(own))).alias("e"))
    return _summed(rows, PAIR)


def compare(pairs: DataFrame, seed: int) -> tuple[DataFrame, DataFrame]:
    """Subtract and peel one pair of sketches for each row of ``pairs``.

    ``pairs`` has row, side, width and the digests of both sides, ``own`` and ``other``.
    Returns (row, side, found) and the (row, side) that could not be peeled to the end.
    All steps group by row and side, so rows bucketed by ``row`` never move.
    """
    def signed(side: str, sign: int) -> Column:
        return F.transform(side, lambda k: F.struct(k.alias("key"), F.lit(sign).cast("long").alias("sign")))

    both = F.concat(signed("own", 1), signed("other", -1))
    signed_keys = pairs.select(*PAIR, F.explode(both).alias("k")).select(*PAIR, "k.*")
    cells = sketches(signed_keys, PAIR, seed)
    found = None
    for _ in range(PASSES):
        for row in range(ROWS):
            cells = peel_row(cells, row, seed)
        left = materialize(cells.where(f"cell = {FOUND} OR n <> 0 OR key <> 0 OR chk <> 0"))
        open_ = left.where(f"cell <> {FOUND}").select("row", "side").distinct()
        cells = left.join(open_, ["row", "side"], "left_semi")
        own = left.where(f"cell = {FOUND}").join(open_, ["row", "side"], "left_anti").select("row", "side", F.col("n").alias("found"))
        found = own if found is None else found.unionByName(own)
    return found, open_


def differences(compared: DataFrame) -> DataFrame:
    """Sizes of both differences of each row: row, to_edited, to_next.

    ``compared`` has row, keys, edited_keys, next_keys and is bucketed by row.  A side that
    does not peel in sketches of the fingerprint's size is compared again in sketches
    sized by both sets, with fresh hash functions, and these grow until it peels.
    """
    asked, seed, done = compared.withColumn("sides", F.array(F.lit(0), F.lit(1))), 0, None
    while True:
        other = F.when(F.col("side") == 0, F.col("edited_keys")).otherwise(F.col("next_keys"))
        pairs = asked.withColumn("side", F.explode("sides")).select("row", "side", F.col("keys").alias("own"), other.alias("other"))
        wide = F.size("own") + F.size("other")
        width = F.lit(ROW_CELLS) if seed == 0 else F.greatest(F.lit(2 * ROW_CELLS), wide * SPARE) * (1 << (seed - 1))
        found, open_ = compare(pairs.withColumn("width", width.cast("long")), seed)
        done = found if done is None else done.unionByName(found)
        if open_.isEmpty():
            break
        again = open_.groupBy("row").agg(F.collect_set("side").alias("sides"))
        asked, seed = compared.join(again.hint("merge"), "row"), seed + 1
    side = lambda n: F.coalesce(F.max(F.when(F.col("side") == n, F.col("found"))), F.lit(0))
    return done.groupBy("row").agg(side(0).alias("to_edited"), side(1).alias("to_next"))


def printed(compared: DataFrame) -> DataFrame:
    """The cells of both fingerprints of each row as text: row, cells, edited_cells.

    Cells that are not empty, as number.count.key.check in hexadecimal.
    """
    both = compared.select("row", F.explode(F.array(*[
        F.struct(F.lit(n).alias("side"), F.col(c).alias("own")) for n, c in enumerate(("keys", "edited_keys"))
    ])).alias("s")).select("row", "s.side", F.lit(ROW_CELLS).cast("long").alias("width"), F.explode("s.own").alias("key"))
    cells = sketches(both.withColumn("sign", F.lit(1).cast("long")), PAIR, 0)
    as_text = F.concat_ws(".", F.hex("cell"), F.hex("n"), F.hex("key"), F.hex("chk"))
    listed = cells.groupBy("row").agg(*[
        F.sort_array(F.collect_list(F.when(F.col("side") == n, F.struct("cell", as_text.alias("t"))))).alias(f"cells{n}") for n in (0, 1)
    ])
    text = lambda n: F.concat_ws(",", F.transform(f"cells{n}", lambda c: c["t"]))
    return listed.select("row", text(0).alias("cells"), text(1).alias("edited_cells"))


def likeness(own: Column, other: Column, differing: Column) -> Column:
    """Shared digests out of all; two texts without digests are alike."""
    total = own + other
    return F.when(total == 0, 1.0).otherwise((total - differing) / (total + differing))


def with_next(docs: DataFrame) -> DataFrame:
    """Each distinct (doc_id, text) as ``row``, with its edited text and the digests of the next document."""
    keyed = docs.select(
        F.coalesce(F.col("doc_id").cast("string"), F.lit("null")).alias("id_key"),
        F.unhex(F.sha2(whole_text(), 256)).alias("sha"),
        whole_text().alias("text"),
    )
    narrow = keyed.groupBy("id_key", "sha").agg(F.max(F.length("text")).alias("n_chars"), F.count("*").alias("copies"))
    ranked = materialize(
        ordered_scan(
            narrow.withColumn("doc_id", F.col("id_key").try_cast("bigint")),
            [],
            [F.col("doc_id").desc_nulls_last(), F.col("sha").desc()],
            {"row": Running("sum", F.lit(1).cast("bigint"), before=True)},
        )
    )
    last = F.lit(ranked.count() - 1)
    follows = F.when(F.col("row") == last, F.lit(0)).otherwise(F.col("row") + 1)
    before = ranked.select(
        follows.alias("row"), F.col("id_key").alias("to_id"), F.col("sha").alias("to_sha"), F.floor(F.col("n_chars") / 3).alias("wanted")
    )
    places = materialize(ranked.join(before, "row"))
    # Both sides below read this one shuffle of the texts; repeated rows end in it.
    texts = keyed.groupBy("id_key", "sha").agg(F.first("text").alias("text")).join(places, ["id_key", "sha"])
    sent = texts.select(
        F.col("to_id").alias("id_key"),
        F.col("to_sha").alias("sha"),
        F.substring(F.col("text"), F.lit(1), F.col("wanted").cast("int")).alias("lent"),
        digests(F.col("text")).alias("next_keys"),
    )
    n_chars = F.length("text").cast("long")
    kept = F.substring(F.col("text"), F.lit(1), (n_chars - F.floor(n_chars / 3)).cast("int"))
    return texts.join(sent, ["id_key", "sha"]).select(
        "row", "doc_id", "copies", "text", n_chars.alias("n_chars"), F.concat(kept, "lent").alias("edited"), "next_keys"
    )


def _bucketed(docs: DataFrame) -> DataFrame:
    """Digests of each row and its edit as a table bucketed by row."""
    spark = docs.sparkSession
    rows = with_next(docs).select(
        "row", "doc_id", "copies", "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        digests(F.col("text")).alias("keys"),
        digests(F.col("edited")).alias("edited_keys"),
        "next_keys",
    )
    buckets = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = shared_path(spark, "digests")
    name = "compared_" + path.rsplit("-", 1)[-1]
    rows.repartition(buckets, "row").write.format("parquet").bucketBy(buckets, "row").sortBy("row").option("path", path).saveAsTable(name)
    return spark.table(name)


def fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprint every text of ``docs`` and its edited text, and compare.

    Needs doc_id and text; other columns are ignored.  A null text is empty and has no
    digests; two texts without digests are alike (1.0).  The next document is the next by
    descending id (null last, equal ids by text digest); after the last comes the first,
    and a single document is its own next.  Rows that repeat both id and text give equal
    rows, and none of them is the next of another.  No documents give no rows.

    Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next, n_digests, edited_differs (digests in one of the text and its edit only).
    """
    # Bucketed by row: everything below groups and joins by row without moving the digests.
    compared = _bucketed(docs)
    release(docs.sparkSession)
    sized = compared.select(
        "row", "doc_id", "copies", "n_chars", "edited_sha256",
        F.size("keys").alias("own"), F.size("edited_keys").alias("edited"), F.size("next_keys").alias("next"),
    )
    joined = sized.join(printed(compared), "row", "left").join(differences(compared), "row", "left")
    text = lambda size, cells: F.concat(F.col(size).cast("string"), F.lit(":"), F.coalesce(cells, F.lit("")))
    to_edited, to_next = F.coalesce("to_edited", F.lit(0)), F.coalesce("to_next", F.lit(0))
    each = F.explode(F.array_repeat(F.lit(True), F.col("copies").cast("int")))
    return joined.withColumn("_copy", each).select(
        "doc_id", "n_chars", "edited_sha256",
        text("own", "cells").alias("fingerprint"),
        text("edited", "edited_cells").alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("edited"), to_edited).alias("near_edited"),
        likeness(F.col("own"), F.col("next"), to_next).alias("near_next"),
        F.col("own").cast("long").alias("n_digests"),
        to_edited.alias("edited_differs"),
    )
