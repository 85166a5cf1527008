"""Deduplication, set and hierarchy queries over the star schema."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.functions import text as t
from lectern.operators import constraints, dedup, feedback, hierarchy
from lectern.plans import bindings as b
from lectern.sources import feeds

VERSION_ORDER = ["l_quantity", "l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice"]
_LATEST_SQL = """
latest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber
   ORDER BY l_quantity DESC, l_shipdate DESC, l_partkey DESC, l_suppkey DESC, l_extendedprice DESC) AS rn FROM lineitem) WHERE rn = 1)"""


def _latest(spark, folder):
    entries = b.table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", *VERSION_ORDER, "l_returnflag"
    )
    return dedup.latest_version(entries, ["l_orderkey", "l_linenumber"], [F.col(c) for c in VERSION_ORDER])


def latest_version_dedup(spark, folder):
    return _latest(spark, folder).select(
        "l_orderkey", "l_linenumber", "l_quantity", "l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice"
    )


def newest_feed_entries(spark, folder):
    order = [F.desc("l_shipdate"), F.desc("l_quantity"), F.desc("l_orderkey"), F.desc("l_linenumber")]
    return dedup.newest_limited(_latest(spark, folder), order, 200, F.col("l_returnflag"), ["R"]).select(
        "l_orderkey", "l_linenumber", "l_shipdate", "l_returnflag"
    )


def retrieval_counts(spark, folder):
    return dedup.retrieval_counts(
        b.table(spark, folder, "lineitem"), ["l_orderkey", "l_linenumber"], F.col("l_quantity") < 2
    )


def category_filter(spark, folder):
    """Orders as entries: the primary category must be allowed unless cross-lists are included."""
    entries = b.table(spark, folder, "orders").withColumn("primary_category", F.col("o_orderpriority"))
    wanted = ["1-URGENT", "2-HIGH"]
    cross_list = feeds.in_categories(entries.where("o_orderkey % 2 = 0"), wanted, True)
    kept = cross_list.unionByName(feeds.in_categories(entries.where("o_orderkey % 2 <> 0"), wanted, False))
    return kept.groupBy("o_orderpriority").agg(F.count("*").alias("n"))


def announced_entries(spark, folder):
    """Views as new entries, clicks as cross-listed ones."""
    kind = F.when(F.col("event_type") == "view", "new").when(F.col("event_type") == "click", "cross").otherwise("replace")
    entries = b.table(spark, folder, "events").withColumn("announce_type", kind)
    kept = feeds.announced(entries, include_cross_list=True)
    return kept.select("event_id", "event_type", F.col("user_id"))


def latest_date_only(spark, folder):
    newest = dedup.latest_date_only(
        b.table(spark, folder, "orders").withColumn("day", F.date_trunc("month", "o_orderdate").cast("date")), "day"
    )
    kept = newest.where(F.lower("o_orderpriority").isin("1-urgent", "2-high", "5-low"))
    return kept.select("o_orderkey", F.date_format("day", "yyyy-MM-dd").alias("day"), "o_orderpriority")


def duplicate_keys(spark, folder):
    return constraints.duplicates(b.table(spark, folder, "lineitem"), "l_orderkey", "l_linenumber")


def union_sources(spark, folder):
    people = b.table(spark, folder, "customer").select(
        F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation"),
        F.col("c_mktsegment").alias("segment"), F.lit("customer").alias("source"),
    )
    firms = b.table(spark, folder, "supplier").select(
        F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_nationkey").alias("nation"),
        F.lit("supplier").alias("source"),
    )
    return dedup.union_sources(people, firms)


def union_distinct_conflicts(spark, folder):
    docs = b.table(spark, folder, "documents").select(F.md5("text").alias("text_digest"), "lang", "source")
    merged = dedup.distinct_by_id(docs, "text_digest")
    return merged.select("text_digest", "copies", "conflict")


def except_refs(spark, folder):
    known = b.table(spark, folder, "labels").select("doc_id")
    return b.table(spark, folder, "documents").select("doc_id").join(known, "doc_id", "left_anti")


def favorite_irrelevant_overlap(spark, folder):
    """Papers named both favourite and irrelevant by raw commands: conflicts that replay must settle."""
    commands = b.commands(spark, folder).where("value")
    flags = commands.groupBy("paper_id").agg(
        F.bool_or(F.col("action") == "set_favorite").alias("fav"),
        F.bool_or(F.col("action") == "set_irrelevant").alias("irr"),
    )
    state = feedback.replay(b.commands(spark, folder))
    return flags.where("fav AND irr").join(state, "paper_id").select(
        "paper_id", (F.col("favorite") & F.col("irrelevant")).alias("still_conflicting")
    )


def subset_check(spark, folder):
    """Orders all of whose parts are labelled large."""
    lines = b.table(spark, folder, "lineitem").select("l_orderkey", F.col("l_partkey").alias("p_partkey"))
    large = b.table(spark, folder, "part").where("p_size >= 20").select("p_partkey", F.lit(True).alias("known"))
    joined = lines.join(large, "p_partkey", "left")
    return joined.groupBy("l_orderkey").agg(
        F.count_if(F.col("known").isNull()).alias("unknown_count"),
        F.bool_and(F.col("known").isNotNull()).alias("is_subset"),
    )


def _collections(spark, folder):
    region = b.table(spark, folder, "region").select(
        F.concat(F.lit("r"), "r_regionkey").alias("key"), F.lit(None).cast("string").alias("parent"),
        F.col("r_name").alias("name"),
    )
    nation = b.table(spark, folder, "nation").select(
        F.concat(F.lit("n"), "n_nationkey").alias("key"),
        # Nation 7 hangs under itself and nation 11 under a region that does not exist.
        F.when(F.col("n_nationkey") == 7, "n7").when(F.col("n_nationkey") == 11, "r99")
        .otherwise(F.concat(F.lit("r"), "n_regionkey")).alias("parent"),
        F.col("n_name").alias("name"),
    )
    customer = b.table(spark, folder, "customer").select(
        F.concat(F.lit("c"), "c_custkey").alias("key"), F.concat(F.lit("n"), "c_nationkey").alias("parent"),
        F.col("c_name").alias("name"),
    )
    return region.unionByName(nation).unionByName(customer)


_TREE_SQL = """
nodes AS (
  SELECT 'r' || r_regionkey AS key, CAST(NULL AS VARCHAR) AS parent, r_name AS name FROM region
  UNION ALL SELECT 'n' || n_nationkey, CASE n_nationkey WHEN 7 THEN 'n7' WHEN 11 THEN 'r99' ELSE 'r' || n_regionkey END, n_name FROM nation
  UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey, c_name FROM customer),
up AS (
  SELECT key AS start, key, parent, name AS path, 1 AS depth, [key] AS seen FROM nodes
  UNION ALL
  SELECT up.start, n.key, n.parent, n.name || '/' || up.path, up.depth + 1, list_append(up.seen, n.key)
  FROM up JOIN nodes n ON n.key = up.parent WHERE NOT list_contains(up.seen, n.key)),
tree AS (SELECT start AS key, arg_max(path, depth) AS path, max(depth) AS depth, arg_max(coalesce(parent, ''), depth) AS top,
   arg_max(seen, depth) AS seen FROM up GROUP BY start),
resolved AS (SELECT key, CASE WHEN top = '' THEN 'ok' WHEN list_contains(seen, top) THEN 'collection_cycle' ELSE 'missing_collection' END AS status,
   path, CAST(depth AS BIGINT) AS depth FROM tree)"""


def recursive_paths(spark, folder):
    return hierarchy.ancestor_paths(_collections(spark, folder), "key", "parent", "name")


def _interest_items(spark, folder):
    """Orders filed under their customer; urgent ones also under a nation, low ones nowhere."""
    orders = b.table(spark, folder, "orders")
    keys = (
        F.when(F.col("o_orderpriority") == "5-LOW", F.array().cast("array<string>"))
        .when(
            F.col("o_orderpriority") == "1-URGENT",
            F.array(F.concat(F.lit("c"), "o_custkey"), F.concat(F.lit("n"), F.col("o_orderkey") % 25)),
        )
        .otherwise(F.array(F.concat(F.lit("c"), "o_custkey")))
    )
    return orders.select("o_orderkey", keys.alias("collection_keys"))


INCLUDE, EXCLUDE = ["REGION_[0-3]/**", "ASIA/**", "A*/**", "E*/**"], ["*/NATION_1*/**"]


def _interest_corpus(spark, folder):
    paths = hierarchy.ancestor_paths(_collections(spark, folder), "key", "parent", "name")
    placed = hierarchy.item_paths(
        _interest_items(spark, folder), "o_orderkey", "collection_keys", paths, "key"
    )
    included = F.exists("paths", lambda p: t.matches_any(p, INCLUDE))
    excluded = F.exists("paths", lambda p: t.matches_any(p, EXCLUDE))
    verdict = (
        F.when((F.size("paths") == 0) & (F.col("listed_keys") > 0), "invalid")
        .when(included & ~excluded, "eligible")
        .otherwise("excluded")
    )
    return placed.withColumn("verdict", verdict)


def interest_paths(spark, folder):
    return _interest_corpus(spark, folder).select(
        "o_orderkey", F.array_join("paths", "|").alias("paths"), "broken_keys", "verdict"
    )


def interest_fingerprint(spark, folder):
    corpus = _interest_corpus(spark, folder).where("verdict = 'eligible'")
    digest = F.sha2(F.concat_ws("\x1f", F.col("o_orderkey").cast("string"), F.array_join("paths", "|")), 256)
    return dedup.set_fingerprint(corpus.select(digest.alias("digest")), F.col("digest"))


_ITEMS_SQL = (
    _TREE_SQL
    + r""",
items AS (SELECT o_orderkey, CASE o_orderpriority WHEN '5-LOW' THEN []::VARCHAR[]
    WHEN '1-URGENT' THEN ['c' || o_custkey, 'n' || (o_orderkey % 25)] ELSE ['c' || o_custkey] END AS keys FROM orders),
placed AS (SELECT o_orderkey, coalesce(list_sort(list_distinct(list(r.path) FILTER (WHERE r.status = 'ok'))), []::VARCHAR[]) AS paths,
    count(k) FILTER (WHERE coalesce(r.status, 'missing') <> 'ok') AS broken_keys, count(k) AS listed
  FROM (SELECT o_orderkey, unnest(keys) AS k FROM items UNION ALL SELECT o_orderkey, NULL FROM items WHERE len(keys) = 0) x
  LEFT JOIN resolved r ON r.key = x.k GROUP BY o_orderkey),
verdicts AS (SELECT *, CASE WHEN len(paths) = 0 AND listed > 0 THEN 'invalid'
   WHEN len(list_filter(paths, lambda p: regexp_matches(p, '^(REGION_[0-3]|ASIA|A[^/]*|E[^/]*)/.+$'))) > 0
    AND len(list_filter(paths, lambda p: regexp_matches(p, '^[^/]+/NATION_1[^/]*/.+$'))) = 0 THEN 'eligible' ELSE 'excluded' END AS verdict FROM placed)"""
)

_LANES = ", ".join(
    f"CAST(sum(('0x' || substr(d, {1 + 8 * i}, 8))::BIGINT) AS VARCHAR)" for i in range(8)
)

PLANS = {
    "latest_version_dedup": (
        latest_version_dedup,
        f"WITH {_LATEST_SQL} SELECT l_orderkey, l_linenumber, l_quantity, l_shipdate, l_partkey, l_suppkey, l_extendedprice FROM latest",
    ),
    "newest_feed_entries": (
        newest_feed_entries,
        f"""WITH {_LATEST_SQL} SELECT l_orderkey, l_linenumber, l_shipdate, l_returnflag FROM
   (SELECT * FROM latest ORDER BY l_shipdate DESC, l_quantity DESC, l_orderkey DESC, l_linenumber DESC LIMIT 200) WHERE l_returnflag = 'R'""",
    ),
    "retrieval_counts": (
        retrieval_counts,
        """SELECT count(*) AS retrieved_count, count(DISTINCT (l_orderkey, l_linenumber)) AS deduplicated_count,
   count(*) FILTER (WHERE l_quantity < 2) AS invalid_count FROM lineitem""",
    ),
    "category_filter": (
        category_filter,
        "SELECT o_orderpriority, count(*) AS n FROM orders WHERE o_orderkey % 2 = 0 OR o_orderpriority IN ('1-URGENT', '2-HIGH') GROUP BY 1",
    ),
    "announced_entries": (
        announced_entries,
        "SELECT event_id, event_type, user_id FROM events WHERE event_type IN ('view', 'click')",
    ),
    "latest_date_only": (
        latest_date_only,
        """WITH d AS (SELECT *, date_trunc('month', o_orderdate) AS day FROM orders)
SELECT o_orderkey, strftime(day, '%Y-%m-%d') AS day, o_orderpriority FROM d WHERE day = (SELECT max(day) FROM d)
  AND lower(o_orderpriority) IN ('1-urgent', '2-high', '5-low')""",
    ),
    "duplicate_keys": (
        duplicate_keys,
        "SELECT l_orderkey, l_linenumber, count(*) AS copies FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1",
    ),
    "union_sources": (
        union_sources,
        """SELECT c_custkey AS id, c_name AS name, c_nationkey AS nation, c_mktsegment AS segment, 'customer' AS source FROM customer
UNION ALL SELECT s_suppkey, s_name, s_nationkey, NULL, 'supplier' FROM supplier""",
    ),
    "union_distinct_conflicts": (
        union_distinct_conflicts,
        """SELECT md5(text) AS text_digest, count(*) AS copies, count(DISTINCT (lang, source)) > 1 AS conflict FROM documents GROUP BY 1""",
    ),
    "except_refs": (
        except_refs,
        "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    ),
    "favorite_irrelevant_overlap": (
        favorite_irrelevant_overlap,
        f"""WITH {b.STATE_SQL} SELECT paper_id, favorite AND irrelevant AS still_conflicting FROM state WHERE paper_id IN
  (SELECT paper_id FROM commands WHERE value AND action = 'set_favorite') AND paper_id IN
  (SELECT paper_id FROM commands WHERE value AND action = 'set_irrelevant')""",
    ),
    "subset_check": (
        subset_check,
        """SELECT l_orderkey, count(*) FILTER (WHERE p_size < 20) AS unknown_count, bool_and(p_size >= 20) AS is_subset
FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1""",
    ),
    "recursive_paths": (
        recursive_paths,
        f"""WITH RECURSIVE {_TREE_SQL} SELECT key, CASE WHEN status = 'ok' THEN path END AS path,
   CASE WHEN status = 'ok' THEN depth END AS depth, status FROM resolved""",
    ),
    "interest_paths": (
        interest_paths,
        f"WITH RECURSIVE {_ITEMS_SQL} SELECT o_orderkey, coalesce(array_to_string(paths, '|'), '') AS paths, broken_keys, verdict FROM verdicts",
    ),
    "interest_fingerprint": (
        interest_fingerprint,
        f"""WITH RECURSIVE {_ITEMS_SQL},
e AS (SELECT sha256(o_orderkey || chr(31) || array_to_string(paths, '|')) AS d FROM verdicts WHERE verdict = 'eligible'),
s AS (SELECT count(*) AS n, [{_LANES}] AS lanes FROM e)
SELECT n AS rows, sha256(n || ':' || array_to_string(lanes, ':')) AS fingerprint FROM s""",
    ),
}
