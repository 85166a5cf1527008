"""Model answers: unfence, parse, fill in what is missing and list the claims."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lectern.functions.text import unfenced
from lectern.schemas import ANALYSIS
from lectern.session import materialize

# Optional single claims and the claim kind each field must hold.
SINGLE_CLAIMS = (
    ("chinese_title", "title"),
    ("recommendation_reason", "recommendation"),
    ("research_problem", "problem"),
    ("insight_formation_logic", "insight_logic"),
    ("method_overview", "method"),
    ("differences_from_prior_work", "difference"),
)
# Claim lists as (field, member that holds the claim, kind).
LISTED_CLAIMS = (
    ("insights", None, "insight"),
    ("supporting_visuals", "support_explanation", "support"),
    ("method_modules", "purpose", "method"),
    ("parameters", "role", "parameter"),
    ("ablations", "conclusion", "ablation"),
    ("experimental_conclusions", None, "result"),
    ("limitations", None, "limitation"),
)


def parse(answers: DataFrame, answer: str) -> DataFrame:
    """Add ``analysis`` and ``failure``; missing lists become empty, missing claims stay null."""
    # Spark folds field access into from_json and would parse each answer once per
    # field.  Exploding a one-element array keeps it to a single parse.
    bare = answers.withColumn("_bare", F.explode(F.array(unfenced(F.col(answer)))))
    # Inside brackets trailing text is an error too, and a second value shows up as a second element.
    listed = F.try_parse_json(F.concat(F.lit("["), F.col("_bare"), F.lit("]")))
    once = F.struct(
        F.from_json("_bare", ANALYSIS).alias("analysis"),
        (listed.isNull() | F.variant_get(listed, "$[1]", "string").isNotNull()).alias("malformed"),
    )
    parsed = bare.withColumn("_p", F.explode(F.array(once))).select(
        *answers.columns, "_p.analysis", "_p.malformed"
    )
    filled = F.col("analysis")
    for field, _, _ in LISTED_CLAIMS:
        empty = F.array().cast(ANALYSIS[field].dataType)
        filled = filled.withField(field, F.coalesce(F.col("analysis")[field], empty))
    invalid = F.col("analysis.paper_id").isNull() | F.col("analysis.english_title").isNull()
    failure = F.when(F.col("malformed"), "analysis_malformed_json").when(invalid, "analysis_schema_invalid")
    return parsed.select(
        *answers.columns,
        failure.alias("failure"),
        F.when(failure.isNull(), filled).alias("analysis"),
    )


def _located(claim: Column, path: Column, kind: str) -> Column:
    return F.struct(claim.alias("claim"), path.alias("field_path"), F.lit(kind).alias("expected_kind"))


def _listed(field: str, member: str | None, kind: str) -> Column:
    suffix = f".{member}" if member else ""

    def locate(entry: Column, index: Column) -> Column:
        claim = entry[member] if member else entry
        return _located(claim, F.concat(F.lit(f"{field}."), index.cast("string"), F.lit(suffix)), kind)

    return F.transform(F.col("analysis")[field], locate)


def claim_locations(parsed: DataFrame, key: str) -> DataFrame:
    """Every claim of an analysis with its field path and the kind that field requires, in one pass."""
    single = F.filter(
        F.array(*[_located(F.col("analysis")[f], F.lit(f), kind) for f, kind in SINGLE_CLAIMS]),
        lambda e: e["claim"].isNotNull(),
    )
    everything = F.concat(single, *[_listed(*entry) for entry in LISTED_CLAIMS])
    return parsed.where("analysis IS NOT NULL").select(key, F.posexplode(everything).alias("claim_pos", "_e")).select(
        key, "claim_pos", "_e.field_path", "_e.expected_kind", "_e.claim.*"
    )


def coverage_gaps(parsed: DataFrame, key: str) -> DataFrame:
    """Fields without content, one row each."""
    a = F.col("analysis")
    present = {
        "recommendation": a["recommendation_reason"].isNotNull(),
        "research-problem": a["research_problem"].isNotNull(),
        "visuals": F.size(a["supporting_visuals"]) > 0,
        "parameters": F.size(a["parameters"]) > 0,
        "ablations": F.size(a["ablations"]) > 0,
        "limitations": F.size(a["limitations"]) > 0,
    }
    missing = F.array_compact(F.array(*[F.when(~ok, F.lit(name)) for name, ok in present.items()]))
    return parsed.where("analysis IS NOT NULL").select(key, F.explode(missing).alias("missing_field"))


def numbered_sections(names: Column, present: Column) -> Column:
    """Two-digit numbers for the present sections of an array, null for absent ones."""
    return F.transform(
        names,
        lambda name, i: F.when(
            present[i],
            F.concat(
                F.lpad(
                    F.size(F.filter(F.slice(present, F.lit(1), i + 1), lambda p: p)).cast("string"), 2, "0"
                ),
                F.lit(" "),
                name,
            ),
        ),
    )


#: The members that make an object a claim.
CLAIM_MEMBERS = ("claim_id", "kind", "evidence_ids")


def harvest_claims(rows: DataFrame, key: str, payload: str) -> DataFrame:
    """Claims at any depth of a JSON ``payload``, with the path they stand at.

    An object that has all :data:`CLAIM_MEMBERS`, null or not, is a claim; claims may hold
    claims.  The tree is walked level by level as VARIANT until no branch is left: every
    node moves on to its children where it is, so nothing is shuffled and a deep payload
    costs more levels, not more memory.  Text that is no JSON has no claims.

    Returns ``key``, path (``$.member[position]``), claim_id, kind, evidence_ids.
    """
    spark = rows.sparkSession
    level = rows.select(F.col(key).alias("_key"), F.lit("$").alias("path"), F.try_parse_json(payload).alias("node")).where("node IS NOT NULL")
    found = None
    while True:
        level = materialize(level)
        if level.isEmpty():
            break
        has_all = F.lit(True)
        for member in CLAIM_MEMBERS:
            has_all &= F.try_variant_get("node", f"$.{member}", "variant").isNotNull()
        claims = level.where(has_all).select(
            F.col("_key").alias(key), "path",
            F.try_variant_get("node", "$.claim_id", "string").alias("claim_id"),
            F.try_variant_get("node", "$.kind", "string").alias("kind"),
            F.try_variant_get("node", "$.evidence_ids", "array<string>").alias("evidence_ids"),
        )
        found = claims if found is None else found.unionByName(claims)
        level = spark.sql(
            "SELECT t._key, concat(t.path, coalesce('.' || e.key, '[' || e.pos || ']')) AS path, e.value AS node "
            "FROM {level} t, LATERAL variant_explode(t.node) e",
            level=level,
        )
    return rows.limit(0).select(key, *[F.lit(None).cast(k).alias(n) for n, k in CLAIM_ROW.items()]) if found is None else found


CLAIM_ROW = {"path": "string", "claim_id": "string", "kind": "string", "evidence_ids": "array<string>"}
