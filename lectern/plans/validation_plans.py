"""Claim validation over the star schema: orders are claims, parts are evidence, customers are papers."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.operators import answers, constraints, outline, validation
from lectern.plans import bindings as b
from lectern.plans.document_plans import _OUTLINE_SQL, _outlined

KINDS = ["insight", "method", "result", "limitation", "problem"]


def _kind(column):
    return F.element_at(F.array(*[F.lit(k) for k in KINDS]), F.substring(column, 1, 1).cast("int"))


def _orders(spark, folder):
    kind = _kind("o_orderpriority")
    odd = (F.col("o_orderstatus") == "P") & (F.col("o_totalprice") > 300000)
    return b.table(spark, folder, "orders").select(
        F.col("o_custkey").alias("paper_id"),
        F.col("o_orderkey").alias("claim_pos"),
        F.date_format("o_orderdate", "'c'yyyyMM").alias("claim_id"),
        F.when(odd, "insight").otherwise(kind).alias("kind"),
        kind.alias("expected_kind"),
        F.when(F.col("o_orderstatus") == "F", "system_inference").otherwise("paper_text").alias("source_type"),
        ((F.col("o_orderstatus") == "F") != (F.col("o_totalprice") > 480000)).alias("inferred"),
    )


_ORDERS_SQL = """
claims AS (SELECT o_custkey AS paper_id, o_orderkey AS claim_pos, 'c' || strftime(o_orderdate, '%Y%m') AS claim_id,
  ['insight', 'method', 'result', 'limitation', 'problem'][CAST(substr(o_orderpriority, 1, 1) AS INT)] AS expected_kind,
  CASE WHEN o_orderstatus = 'P' AND o_totalprice > 300000 THEN 'insight' ELSE ['insight', 'method', 'result', 'limitation', 'problem'][CAST(substr(o_orderpriority, 1, 1) AS INT)] END AS kind,
  CASE WHEN o_orderstatus = 'F' THEN 'system_inference' ELSE 'paper_text' END AS source_type,
  (o_orderstatus = 'F') <> (o_totalprice > 480000) AS inferred FROM orders),
lines AS (SELECT o_custkey AS paper_id, l_orderkey AS claim_pos, l_partkey AS evidence_id, l_linenumber, l_returnflag, l_quantity, l_discount, l_tax,
  l_shipdate, l_orderkey * 10 + l_linenumber AS pos FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
packet AS (SELECT l.*, CASE WHEN p_size <= 30 THEN 'text' WHEN p_size <= 40 THEN 'table' ELSE 'figure' END AS kind, p_size <= 15 AS abstract_only,
  p_brand AS label, CAST(p_size AS BIGINT) AS pdf_page FROM lines l JOIN part ON p_partkey = evidence_id WHERE l_returnflag <> 'R'),
known AS (SELECT paper_id, evidence_id, any_value(kind) AS kind, any_value(abstract_only) AS abstract_only, any_value(label) AS label, any_value(pdf_page) AS pdf_page
  FROM packet GROUP BY 1, 2)"""


def _lines(spark, folder):
    lines = b.table(spark, folder, "lineitem").select(
        "l_orderkey", "l_partkey", "l_linenumber", "l_returnflag", "l_quantity", "l_discount", "l_tax", "l_shipdate"
    )
    owners = b.table(spark, folder, "orders").select("o_orderkey", F.col("o_custkey").alias("paper_id"))
    return lines.join(owners, F.col("l_orderkey") == F.col("o_orderkey")).select(
        "paper_id", F.col("l_orderkey").alias("claim_pos"), F.col("l_partkey").alias("evidence_id"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pos"),
        "l_returnflag", "l_quantity", "l_discount", "l_tax", "l_shipdate",
    )


def _packet(spark, folder, lines):
    parts = b.table(spark, folder, "part").select(
        F.col("p_partkey").alias("evidence_id"),
        F.when(F.col("p_size") <= 30, "text").when(F.col("p_size") <= 40, "table").otherwise("figure").alias("kind"),
        (F.col("p_size") <= 15).alias("abstract_only"),
        F.col("p_brand").alias("label"),
        F.col("p_size").cast("bigint").alias("pdf_page"),
    )
    return lines.where("l_returnflag <> 'R'").join(parts, "evidence_id")


def _claim_inputs(spark, folder):
    lines = _lines(spark, folder)
    return _orders(spark, folder), lines.select("paper_id", "claim_pos", "evidence_id"), _packet(spark, folder, lines)


def claim_verdicts(spark, folder):
    facts = validation.claim_facts(*_claim_inputs(spark, folder))
    return validation.claim_verdicts(facts).select(
        "paper_id", "claim_id", "claim_pos", F.array_join("issue_codes", ",").alias("issue_codes"), "status", "resolved_count"
    )


def _issues(spark, folder):
    claims, edges, packet = _claim_inputs(spark, folder)
    facts = validation.claim_facts(claims, edges, packet)
    return validation.claim_issues(facts, edges, packet).unionByName(validation.missing_insight(claims))


def claim_issues(spark, folder):
    return _issues(spark, folder).groupBy("paper_id", "code", "severity").agg(F.count("*").alias("n"))


def _papers(spark, folder):
    status = (
        F.when(F.col("c_mktsegment") == "MACHINERY", "partial")
        .when(F.col("c_acctbal") < -900, "failed").otherwise("success")
    )
    return b.table(spark, folder, "customer").select(F.col("c_custkey").alias("paper_id"), status.alias("analysis_status"))


def _reports(spark, folder):
    """Reports over inference, kind and grounding rules only, so that every status occurs."""
    claims, edges, packet = _claim_inputs(spark, folder)
    facts = validation.claim_facts(claims, edges, packet)
    rules = ("claim_kind_mismatch", "claim_source_inference_mismatch")
    issues = validation.claim_issues(facts, edges, packet).where(F.col("code").isin(*rules))
    return validation.report_status(
        _papers(spark, folder), issues.unionByName(validation.missing_insight(claims))
    )


_REPORT_SQL = (
    _ORDERS_SQL
    + """,
papers AS (SELECT c_custkey AS paper_id, CASE WHEN c_mktsegment = 'MACHINERY' THEN 'partial' WHEN c_acctbal < -900 THEN 'failed' ELSE 'success' END AS st FROM customer),
errs AS (SELECT paper_id, CAST(sum(CAST(kind <> expected_kind AS INT) + CAST(inferred <> (source_type = 'system_inference') AS INT)) AS BIGINT) AS errors,
  count(*) FILTER (WHERE expected_kind = 'insight') = 0 AS thin FROM claims GROUP BY 1),
r AS (SELECT paper_id, st, coalesce(errors, 0) AS error_count, CASE WHEN coalesce(errors, 0) > 0 THEN 'invalid' WHEN st = 'partial' OR coalesce(thin, false) THEN 'partial' ELSE 'valid' END AS status
  FROM papers LEFT JOIN errs USING (paper_id)),
reports AS (SELECT paper_id, error_count, CASE WHEN st <> 'failed' THEN status END AS report_status,
  CASE WHEN st = 'failed' THEN 'failed' WHEN status = 'valid' THEN 'validated' ELSE status END AS result_status,
  CASE WHEN st <> 'failed' AND status = 'valid' THEN 'eligible' ELSE 'blocked' END AS publication_eligibility FROM r)"""
)


def report_status(spark, folder):
    return _reports(spark, folder)


def publication_decisions(spark, folder):
    return validation.publication(_reports(spark, folder), allow_partial=True).groupBy("decision").agg(
        F.count("*").alias("n"), F.sum("error_count").alias("errors")
    )


def _visuals(spark, folder):
    lines = _lines(spark, folder).where("l_quantity >= 40")
    parts = b.table(spark, folder, "part").select(F.col("p_partkey").alias("evidence_id"), "p_size", "p_brand")
    size = F.col("p_size")
    return lines.join(parts, "evidence_id").select(
        "paper_id", "pos", "evidence_id", F.col("claim_pos").alias("insight_pos"),
        F.when(size <= 30, "text").when(size <= 40, "table").otherwise("figure").alias("kind"),
        F.when(F.col("l_tax") > 0.07, "Brand").otherwise(F.col("p_brand")).alias("label"),
        size.cast("bigint").alias("pdf_page"),
        F.col("l_discount").alias("confidence"),
        F.when(F.col("l_discount") > 0.09, "result").otherwise("support").alias("explanation_kind"),
        (F.col("l_tax") >= 0.01).alias("explanation_cites"),
    )


_VISUALS_SQL = """,
visuals AS (SELECT paper_id, pos, evidence_id, claim_pos AS insight_pos, CASE WHEN p_size <= 30 THEN 'text' WHEN p_size <= 40 THEN 'table' ELSE 'figure' END AS kind,
  CASE WHEN l_tax > 0.07 THEN 'Brand' ELSE p_brand END AS label, CAST(p_size AS BIGINT) AS pdf_page, l_discount AS confidence,
  CASE WHEN l_discount > 0.09 THEN 'result' ELSE 'support' END AS ekind, l_tax >= 0.01 AS cites
  FROM lines JOIN part ON p_partkey = evidence_id WHERE l_quantity >= 40)"""


def visual_issues(spark, folder):
    claims, _, packet = _claim_inputs(spark, folder)
    issues = validation.visual_issues(_visuals(spark, folder), claims, packet)
    return issues.groupBy("paper_id", "code").agg(F.count("*").alias("n"))


def digest_rows(spark, folder):
    claims = _orders(spark, folder)
    return validation.digest(_reports(spark, folder), claims, _visuals(spark, folder))


def _parameter_refs(spark, folder):
    """The references of parameters and of ablations, all from one join of the lines with the orders.

    An order row owns the lines of all rows with its key and customer, so a line counts once
    for each pair of such rows; nothing needs joining again for that.  What belongs to whom is
    only decided on the rows made of a line, which leaves both relations the same shuffles.
    """
    kind, rows = F.col("expected_kind"), F.count("*")
    owners = _orders(spark, folder).where("paper_id IS NOT NULL").groupBy("claim_pos", "paper_id").agg(
        (rows * F.count_if(kind == "result")).cast("int").alias("_as_parameter"), (rows * F.count_if(kind == "method")).cast("int").alias("_as_ablation")
    ).where("_as_parameter + _as_ablation > 0")
    lines = b.table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("claim_pos"), "l_partkey", F.trunc("l_shipdate", "month").alias("_month"), (F.col("l_discount") < 0.08).alias("_concluded")
    )
    month, part = F.date_format("_month", "'c'yyyyMM"), F.col("l_partkey").cast("string")

    def ref(target, value):
        return F.struct(F.lit(target).alias("target"), value.alias("ref"))

    def times(count, *refs):
        return F.flatten(F.array_repeat(F.array_compact(F.array(*refs)), F.col(count)))

    of_parameter = times("_as_parameter", ref("evidence", part), ref("ablation", month))
    of_ablation = times("_as_ablation", ref("parameter", month), ref("visual", part), F.when(F.col("_concluded"), ref("conclusion", part)))
    refs = lines.join(owners, "claim_pos").select(
        "paper_id", F.col("claim_pos").alias("pos"), F.explode(F.concat(of_parameter, of_ablation)).alias("_r")
    ).select("paper_id", "pos", "_r.target", "_r.ref")
    return refs.where("target IN ('evidence', 'ablation')"), refs.where("target IN ('parameter', 'visual', 'conclusion')")


def parameter_issues(spark, folder):
    claims, _, packet = _claim_inputs(spark, folder)
    keyed = claims.select("paper_id", "claim_pos", "expected_kind", "claim_id", "source_type", "inferred")
    parameters = keyed.where("expected_kind = 'result'").select(
        "paper_id", F.col("claim_pos").alias("pos"), F.col("claim_id").alias("name"), "source_type", "inferred"
    )
    ablations = keyed.where("expected_kind = 'method'").select(
        "paper_id", F.col("claim_pos").alias("pos"), F.col("claim_id").alias("ablation_id")
    )
    parameter_refs, ablation_refs = _parameter_refs(spark, folder)
    packet = packet.withColumn("evidence_id", F.col("evidence_id").cast("string"))
    issues = validation.parameter_issues(parameters, parameter_refs, ablations, ablation_refs, packet)
    return issues.groupBy("paper_id", "code").agg(F.count("*").alias("n"))


def validation_inputs(spark, folder):
    orders = b.table(spark, folder, "orders").withColumnRenamed("o_custkey", "paper_id")
    customers = b.table(spark, folder, "customer").withColumnRenamed("c_custkey", "paper_id")
    documents = orders.where("o_orderpriority = '1-URGENT' AND o_totalprice > 250000").select(
        "paper_id", F.when(F.col("o_orderstatus") == "F", "failed").otherwise("success").alias("document_status")
    )
    packets = orders.where("o_orderpriority = '2-HIGH' AND o_totalprice > 250000")
    analyses = orders.where("o_orderpriority = '3-MEDIUM' AND o_totalprice > 250000")
    return validation.input_codes(customers, customers.where("c_acctbal >= 0"), documents, packets, analyses)


def analysis_inputs(spark, folder):
    docs = b.table(spark, folder, "documents").select(F.col("doc_id").alias("paper_id"), "source")
    pages = b.table(spark, folder, "pages")
    candidates = pages.select(F.col("page_id").alias("paper_id"), F.col("url").alias("pdf_url"))
    moved = F.when(F.col("page_id") % 4 == 3, F.concat("url", F.lit("?moved"))).otherwise(F.col("url"))
    documents = pages.where("page_id % 5 <> 0").select(
        F.col("page_id").alias("paper_id"), moved.alias("source_url"),
        F.when(F.col("page_id") % 7 == 0, "failed").otherwise("success").alias("document_status"),
    )
    return validation.analysis_input_codes(docs, candidates, documents)


def text_provenance(spark, folder):
    outlined = _outlined(spark, folder).where(outline.block_type(F.col("label")).isin(*outline.TEXT_BLOCKS))
    pos = F.col("pos")
    evidence = outlined.select(
        "doc_id",
        F.when(pos % 31 == 9, pos + 1000000).otherwise(pos).alias("pos"),
        F.when(pos % 23 == 5, F.concat(F.lit("~"), "text")).otherwise(F.substring("text", 1, 2000)).alias("evidence_text"),
        F.when(pos % 19 == 3, F.col("pdf_page") + 1).otherwise(F.col("pdf_page")).alias("pdf_page"),
        "section_pos",
    )
    issues = validation.provenance_issues(evidence, outlined)
    return issues.groupBy(F.col("paper_id").alias("doc_id"), "code").agg(F.count("*").alias("n"))


def modified_evidence(spark, folder):
    lines = b.lines(spark, folder).select("doc_id", "pos", F.md5("line").alias("digest"))
    changed = F.when((F.col("pos") == 3) & (F.col("doc_id") % 3 == 0), F.lit("changed")).otherwise(F.col("digest"))
    return validation.modified_evidence(lines.withColumn("digest", changed), lines, "doc_id")


def identity_issues(spark, folder):
    docs = b.table(spark, folder, "documents").select(F.col("doc_id").alias("paper_id"), "lang", "source", F.md5("text").alias("fp"))
    pid = F.col("paper_id")
    pairs = docs.select(
        "paper_id", F.when(pid % 13 == 0, pid + 1).otherwise(pid).alias("analysis_paper_id"),
        F.col("source").alias("title"), F.when(pid % 11 == 0, F.upper("source")).otherwise(F.col("source")).alias("english_title"),
        F.col("lang").alias("pdf_url"), F.col("lang").alias("analysis_pdf_url"),
        F.when(pid % 2 == 0, F.col("source")).alias("code_url"),
        F.when(pid % 10 != 0, F.when(pid % 2 == 0, F.col("source"))).alias("analysis_code_url"),
        F.col("fp").alias("document_fingerprint"), F.when(pid % 17 == 0, "stale").otherwise(F.col("fp")).alias("packet_document"),
        F.col("lang").alias("source_url"),
    )
    return validation.identity_issues(pairs).select("paper_id", "code")


def candidate_rules(spark, folder):
    entries = b.table(spark, folder, "lineitem").select(
        F.concat(F.lit("2401."), F.lpad((F.col("l_orderkey") % 100000).cast("string"), 5, "0"),
                 F.when(F.col("l_linenumber") == 3, "v2").otherwise("")).alias("arxiv_id"),
        "l_returnflag", "l_linestatus", "l_shipdate", "l_quantity", "l_linenumber",
    )
    candidates = entries.select(
        F.concat(F.when(F.col("l_quantity") == 7, "arXiv:").otherwise("arxiv:"), F.col("arxiv_id")).alias("paper_id"),
        "arxiv_id",
        F.array("l_returnflag", "l_linestatus").alias("categories"),
        F.when(F.col("l_quantity") == 9, "X").otherwise(F.col("l_returnflag")).alias("primary_category"),
        F.col("l_shipdate").alias("published_at"),
        F.when(F.col("l_quantity") == 11, F.col("l_shipdate") - F.expr("INTERVAL 1 DAY")).otherwise(F.col("l_shipdate")).alias("updated_at"),
        F.array(F.lit("a")).alias("authors"),
    )
    return constraints.candidate_issues(candidates).groupBy("code").agg(F.count("*").alias("n"))


def _answers(spark, folder):
    """A model answer per document, built from its own lines; some are fenced, cut off or incomplete."""
    lines = F.filter(F.split("text", "\n"), lambda x: F.length(x) > 0)

    def claim(kind):
        return lambda x, i: F.struct(
            F.concat(F.lit(f"{kind}-"), i.cast("string")).alias("claim_id"), F.lit(kind).alias("kind"), x.alias("text"),
            F.lit("paper_text").alias("source_type"), F.lit(False).alias("inferred"),
            F.array(F.md5(x)).alias("evidence_ids"),
        )

    titled = F.transform(F.slice(lines, 1, 1), claim("title"))
    payload = F.to_json(
        F.struct(
            F.when(F.col("doc_id") % 17 != 0, F.col("doc_id").cast("string")).alias("paper_id"),
            F.col("source").alias("english_title"),
            F.get(titled, F.lit(0)).alias("chinese_title"),
            F.transform(F.filter(lines, lambda x: F.length(x) % 3 == 0), claim("insight")).alias("insights"),
            F.when(F.col("doc_id") % 4 == 0, F.transform(F.filter(lines, lambda x: F.length(x) % 3 == 1), claim("limitation"))).alias("limitations"),
        )
    )
    fenced = F.concat(F.lit("```json\n"), payload, F.lit("\n```"))
    answer = (
        F.when(F.col("doc_id") % 19 == 0, F.concat(payload, F.lit("} trailing")))
        .when(F.col("doc_id") % 2 == 0, fenced).otherwise(payload)
    )
    return b.documents(spark, folder).select("doc_id", answer.alias("answer"))


def answer_claims(spark, folder):
    parsed = answers.parse(_answers(spark, folder), "answer")
    located = answers.claim_locations(parsed, "doc_id")
    return located.groupBy("doc_id", "expected_kind").agg(
        F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"),
        F.count_if(F.col("kind") != F.col("expected_kind")).alias("kind_mismatches"),
    )


def claim_harvest(spark, folder):
    """Conversations as threads, each turn within the one before it; what the assistant says are claims."""
    said = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    quoted = lambda c: F.to_json(F.struct(c.alias("text")))

    def around(inner, turn):
        claim = F.concat(
            F.lit('{"claim_id":"c'), turn["turn"].cast("string"), F.lit('","kind":"reply","evidence_ids":["'), turn["turn"].cast("string"),
            F.lit('"],"said":'), quoted(turn["text"]), F.lit(',"replies":['), inner, F.lit("]}"),
        )
        other = F.concat(F.lit('{"said":'), quoted(turn["text"]), F.lit(',"reply":'), inner, F.lit("}"))
        return F.when(turn["role"] == "assistant", claim).otherwise(other)

    threads = b.table(spark, folder, "conversations").groupBy("conv_id").agg(said.alias("turns")).select(
        "conv_id", F.aggregate(F.reverse("turns"), F.lit("null"), around).alias("thread")
    )
    claims = answers.harvest_claims(threads, "conv_id", "thread")
    return claims.select("conv_id", "path", "claim_id", "kind", F.array_join("evidence_ids", ",").alias("evidence_ids"))


def answer_failures(spark, folder):
    parsed = answers.parse(_answers(spark, folder), "answer")
    return parsed.groupBy(F.coalesce("failure", F.lit("none")).alias("failure")).agg(F.count("*").alias("n"))


def answer_coverage(spark, folder):
    parsed = answers.parse(_answers(spark, folder), "answer")
    return answers.coverage_gaps(parsed, "doc_id").groupBy("missing_field").agg(F.count("*").alias("n"))


def section_numbers(spark, folder):
    names = F.array(*[F.lit(n) for n in ("reason", "problem", "insight", "limits")])
    present = F.array(F.col("n_chars") % 2 == 0, F.col("n_chars") % 3 == 0, F.lit(True), F.col("lang") == "en")
    numbered = answers.numbered_sections(names, present)
    return b.table(spark, folder, "documents").select("doc_id", F.array_join(numbered, "|").alias("numbered"))


_ANSWER_SQL = (
    b.LINES_SQL
    + """,
good AS (SELECT * FROM lines WHERE length(line) > 0 AND doc_id % 19 <> 0 AND doc_id % 17 <> 0),
first_line AS (SELECT doc_id, arg_min(line, pos) AS line FROM good GROUP BY doc_id),
claims AS (SELECT doc_id, 'title' AS expected_kind, line FROM first_line
  UNION ALL SELECT doc_id, 'insight', line FROM good WHERE length(line) % 3 = 0
  UNION ALL SELECT doc_id, 'limitation', line FROM good WHERE length(line) % 3 = 1 AND doc_id % 4 = 0)"""
)

PLANS = {
    "claim_verdicts": (
        claim_verdicts,
        f"""WITH {_ORDERS_SQL},
refs AS (SELECT l.paper_id, l.claim_pos, l.evidence_id, count(*) AS uses FROM lines l GROUP BY 1, 2, 3),
f AS (SELECT r.paper_id, r.claim_pos, bool_or(uses > 1) AS rep, count(*) FILTER (WHERE k.kind IS NULL) AS unk, count(k.kind) AS res,
  bool_or(k.kind IS NOT NULL AND NOT k.abstract_only) AS grounded FROM refs r LEFT JOIN known k USING (paper_id, evidence_id) GROUP BY 1, 2),
ids AS (SELECT paper_id, claim_id, count(*) AS copies, min(claim_pos) AS first FROM claims GROUP BY 1, 2),
v AS (SELECT c.paper_id, c.claim_id, c.claim_pos, coalesce(res, 0) AS resolved_count, list_filter([
  CASE WHEN rep THEN 'duplicate_claim_evidence_id' END, CASE WHEN kind <> expected_kind THEN 'claim_kind_mismatch' END,
  CASE WHEN inferred <> (source_type = 'system_inference') THEN 'claim_source_inference_mismatch' END,
  CASE WHEN unk > 0 THEN 'unknown_evidence' END,
  CASE WHEN expected_kind = 'insight' AND NOT coalesce(grounded, false) THEN 'abstract_only_insight' END,
  CASE WHEN copies > 1 THEN 'duplicate_claim_id' END], lambda x: x IS NOT NULL) AS codes
  FROM claims c LEFT JOIN f USING (paper_id, claim_pos) JOIN ids i ON i.paper_id = c.paper_id AND i.claim_id = c.claim_id AND i.first = c.claim_pos)
SELECT paper_id, claim_id, claim_pos, coalesce(array_to_string(codes, ','), '') AS issue_codes,
  CASE WHEN len(codes) > 0 THEN 'invalid' ELSE 'valid' END AS status, resolved_count FROM v""",
    ),
    "claim_issues": (
        claim_issues,
        f"""WITH {_ORDERS_SQL},
refs AS (SELECT l.paper_id, l.claim_pos, l.evidence_id, count(*) AS uses FROM lines l GROUP BY 1, 2, 3),
f AS (SELECT r.paper_id, r.claim_pos, bool_or(uses > 1) AS rep, bool_or(k.kind IS NOT NULL AND NOT k.abstract_only) AS grounded
  FROM refs r LEFT JOIN known k USING (paper_id, evidence_id) GROUP BY 1, 2),
x AS (SELECT c.paper_id, c.kind, c.expected_kind, c.inferred, c.source_type, rep, grounded FROM claims c LEFT JOIN f USING (paper_id, claim_pos)),
issues AS (SELECT paper_id, 'duplicate_claim_evidence_id' AS code FROM x WHERE rep
 UNION ALL SELECT paper_id, 'claim_kind_mismatch' FROM x WHERE kind <> expected_kind
 UNION ALL SELECT paper_id, 'claim_source_inference_mismatch' FROM x WHERE inferred <> (source_type = 'system_inference')
 UNION ALL SELECT paper_id, 'abstract_only_insight' FROM x WHERE expected_kind = 'insight' AND NOT coalesce(grounded, false)
 UNION ALL SELECT l.paper_id, 'unknown_evidence' FROM lines l ANTI JOIN known k ON k.paper_id = l.paper_id AND k.evidence_id = l.evidence_id
 UNION ALL SELECT paper_id, 'duplicate_claim_id' FROM claims GROUP BY paper_id, claim_id HAVING count(*) > 1
 UNION ALL SELECT paper_id, 'duplicate_evidence_id' FROM packet GROUP BY paper_id, evidence_id HAVING count(*) > 1
 UNION ALL SELECT paper_id, 'core_insight_missing' FROM claims GROUP BY paper_id HAVING count(*) FILTER (WHERE expected_kind = 'insight') = 0)
SELECT paper_id, code, CASE WHEN code = 'core_insight_missing' THEN 'warning' ELSE 'error' END AS severity, count(*) AS n FROM issues GROUP BY 1, 2""",
    ),
    "report_status": (report_status, f"WITH {_REPORT_SQL} SELECT * FROM reports"),
    "publication_decisions": (
        publication_decisions,
        f"""WITH {_REPORT_SQL} SELECT CASE WHEN result_status = 'validated' AND publication_eligibility = 'eligible' THEN 'full'
  WHEN result_status = 'partial' THEN 'partial' ELSE 'excluded' END AS decision, count(*) AS n, CAST(sum(error_count) AS BIGINT) AS errors FROM reports GROUP BY 1""",
    ),
    "visual_issues": (
        visual_issues,
        f"""WITH {_ORDERS_SQL}{_VISUALS_SQL},
j AS (SELECT v.*, k.kind AS k_kind, k.label AS k_label, k.pdf_page AS k_page, i.claim_pos IS NOT NULL AS insight FROM visuals v
  LEFT JOIN known k USING (paper_id, evidence_id) LEFT JOIN claims i ON i.paper_id = v.paper_id AND i.claim_pos = v.insight_pos AND i.expected_kind = 'insight'),
issues AS (SELECT paper_id, 'supporting_visual_requires_figure_or_table' AS code FROM j WHERE k_kind IS NULL OR k_kind = 'text'
 UNION ALL SELECT paper_id, 'supporting_visual_unknown_insight' FROM j WHERE NOT insight
 UNION ALL SELECT paper_id, 'invalid_support_explanation' FROM j WHERE ekind <> 'support' OR NOT cites
 UNION ALL SELECT paper_id, 'supporting_visual_provenance_mismatch' FROM j WHERE k_kind <> 'text' AND (kind <> k_kind OR label <> k_label OR pdf_page <> k_page)
 UNION ALL SELECT paper_id, 'too_many_supporting_visuals' FROM visuals GROUP BY paper_id HAVING count(*) > 3)
SELECT paper_id, code, count(*) AS n FROM issues GROUP BY 1, 2""",
    ),
    "digest_rows": (
        digest_rows,
        f"""WITH {_REPORT_SQL}{_VISUALS_SQL},
t AS (SELECT paper_id, arg_min(claim_id, claim_pos) FILTER (WHERE expected_kind = 'insight') AS core_insight,
  arg_min(claim_id, claim_pos) FILTER (WHERE expected_kind = 'result') AS experimental_conclusion FROM claims GROUP BY 1),
s AS (SELECT paper_id, arg_max(label, (confidence, -pos, label, pdf_page)) AS evidence_label, arg_max(pdf_page, (confidence, -pos, label, pdf_page)) AS evidence_page FROM visuals GROUP BY 1)
SELECT r.paper_id, core_insight, experimental_conclusion, evidence_label, evidence_page FROM reports r LEFT JOIN t USING (paper_id) LEFT JOIN s USING (paper_id)
WHERE result_status = 'validated' AND publication_eligibility = 'eligible'""",
    ),
    "parameter_issues": (
        parameter_issues,
        f"""WITH {_ORDERS_SQL},
p AS (SELECT * FROM claims WHERE expected_kind = 'result'), a AS (SELECT * FROM claims WHERE expected_kind = 'method'),
pl AS (SELECT l.*, 'c' || strftime(l_shipdate, '%Y%m') AS m FROM lines l JOIN p USING (paper_id, claim_pos)),
al AS (SELECT l.*, 'c' || strftime(l_shipdate, '%Y%m') AS m FROM lines l JOIN a USING (paper_id, claim_pos)),
issues AS (SELECT paper_id, 'parameter_source_inference_mismatch' AS code FROM p WHERE inferred <> (source_type = 'system_inference')
 UNION ALL SELECT paper_id, 'duplicate_parameter_name' FROM p GROUP BY paper_id, claim_id HAVING count(*) > 1
 UNION ALL SELECT paper_id, 'duplicate_ablation_id' FROM a GROUP BY paper_id, claim_id HAVING count(*) > 1
 UNION ALL SELECT x.paper_id, 'parameter_unknown_evidence' FROM pl x ANTI JOIN known k ON k.paper_id = x.paper_id AND k.evidence_id = x.evidence_id
 UNION ALL SELECT x.paper_id, 'parameter_unknown_ablation' FROM pl x ANTI JOIN a ON a.paper_id = x.paper_id AND a.claim_id = x.m
 UNION ALL SELECT x.paper_id, 'ablation_unknown_parameter' FROM al x ANTI JOIN p ON p.paper_id = x.paper_id AND p.claim_id = x.m
 UNION ALL SELECT x.paper_id, 'ablation_requires_visual' FROM al x ANTI JOIN (SELECT * FROM known WHERE kind <> 'text') k ON k.paper_id = x.paper_id AND k.evidence_id = x.evidence_id
 UNION ALL SELECT paper_id, 'ablation_conclusion_missing_visual' FROM (SELECT DISTINCT x.paper_id, x.claim_pos FROM al x
   ANTI JOIN (SELECT * FROM al WHERE l_discount < 0.08) c ON c.paper_id = x.paper_id AND c.claim_pos = x.claim_pos AND c.evidence_id = x.evidence_id))
SELECT paper_id, code, count(*) AS n FROM issues GROUP BY 1, 2""",
    ),
    "validation_inputs": (
        validation_inputs,
        """WITH d AS (SELECT o_custkey AS paper_id, count(*) AS n, min(CASE WHEN o_orderstatus = 'F' THEN 'failed' ELSE 'success' END) AS st FROM orders WHERE o_orderpriority = '1-URGENT' AND o_totalprice > 250000 GROUP BY 1),
p AS (SELECT o_custkey AS paper_id, count(*) AS n FROM orders WHERE o_orderpriority = '2-HIGH' AND o_totalprice > 250000 GROUP BY 1),
a AS (SELECT o_custkey AS paper_id, count(*) AS n FROM orders WHERE o_orderpriority = '3-MEDIUM' AND o_totalprice > 250000 GROUP BY 1),
x AS (SELECT c_custkey AS paper_id, CASE WHEN coalesce(d.n > 1, false) OR coalesce(p.n > 1, false) OR coalesce(a.n > 1, false) THEN 'validation_duplicate_input'
  WHEN c_acctbal < 0 THEN 'validation_candidate_missing' WHEN d.n IS NULL OR p.n IS NULL OR a.n IS NULL THEN 'validation_input_missing'
  WHEN d.st = 'failed' THEN 'validation_document_unavailable' END AS code
  FROM customer LEFT JOIN d ON d.paper_id = c_custkey LEFT JOIN p ON p.paper_id = c_custkey LEFT JOIN a ON a.paper_id = c_custkey)
SELECT paper_id, code, CASE WHEN code = 'validation_input_missing' THEN 'skipped' WHEN code IS NOT NULL THEN 'failed' END AS status FROM x""",
    ),
    "analysis_inputs": (
        analysis_inputs,
        """SELECT doc_id AS paper_id, CASE WHEN page_id IS NULL THEN 'analysis_candidate_missing' WHEN page_id % 5 = 0 THEN 'analysis_document_missing'
  WHEN page_id % 7 = 0 THEN 'analysis_document_failed' WHEN page_id % 4 = 3 THEN 'analysis_document_mismatch' END AS code
FROM documents LEFT JOIN pages ON page_id = doc_id""",
    ),
    "text_provenance": (
        text_provenance,
        f"""WITH {_OUTLINE_SQL}, e AS (SELECT * FROM outlined WHERE label IN ('text', 'list_item', 'formula')),
i AS (SELECT doc_id, CASE WHEN pos % 31 = 9 THEN 'evidence_source_missing' WHEN pos % 23 = 5 OR pos % 19 = 3 OR text = '' THEN 'text_provenance_mismatch' END AS code FROM e)
SELECT doc_id, code, count(*) AS n FROM i WHERE code IS NOT NULL GROUP BY 1, 2""",
    ),
    "modified_evidence": (
        modified_evidence,
        f"WITH {b.LINES_SQL} SELECT DISTINCT doc_id FROM lines WHERE pos = 3 AND doc_id % 3 = 0",
    ),
    "identity_issues": (
        identity_issues,
        """SELECT doc_id AS paper_id, 'paper_id_mismatch' AS code FROM documents WHERE doc_id % 13 = 0
UNION ALL SELECT doc_id, 'candidate_title_mismatch' FROM documents WHERE doc_id % 11 = 0
UNION ALL SELECT doc_id, 'candidate_link_mismatch' FROM documents WHERE doc_id % 10 = 0
UNION ALL SELECT doc_id, 'packet_document_mismatch' FROM documents WHERE doc_id % 17 = 0""",
    ),
    "candidate_rules": (
        candidate_rules,
        """WITH i AS (SELECT 'paper_id_not_derived' AS code FROM lineitem WHERE l_quantity = 7 UNION ALL SELECT 'arxiv_id_not_base' FROM lineitem WHERE l_linenumber = 3
UNION ALL SELECT 'primary_category_missing' FROM lineitem WHERE l_quantity = 9 UNION ALL SELECT 'updated_before_published' FROM lineitem WHERE l_quantity = 11)
SELECT code, count(*) AS n FROM i GROUP BY 1""",
    ),
    "answer_claims": (
        answer_claims,
        f"""WITH {_ANSWER_SQL} SELECT doc_id, expected_kind, count(*) AS n, CAST(sum(length(line)) AS BIGINT) AS chars, CAST(0 AS BIGINT) AS kind_mismatches
FROM claims GROUP BY 1, 2""",
    ),
    "claim_harvest": (
        claim_harvest,
        """WITH steps AS (SELECT conv_id, turn, role, coalesce(string_agg(CASE WHEN role = 'assistant' THEN '.replies[0]' ELSE '.reply' END, '')
  OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS way FROM conversations)
SELECT conv_id, '$' || way AS path, 'c' || turn AS claim_id, 'reply' AS kind, CAST(turn AS VARCHAR) AS evidence_ids FROM steps WHERE role = 'assistant'""",
    ),
    "answer_failures": (
        answer_failures,
        """SELECT CASE WHEN doc_id % 19 = 0 THEN 'analysis_malformed_json' WHEN doc_id % 17 = 0 THEN 'analysis_schema_invalid' ELSE 'none' END AS failure, count(*) AS n FROM documents GROUP BY 1""",
    ),
    "answer_coverage": (
        answer_coverage,
        f"""WITH {_ANSWER_SQL}, d AS (SELECT doc_id FROM documents WHERE doc_id % 19 <> 0 AND doc_id % 17 <> 0),
g AS (SELECT unnest(['recommendation', 'research-problem', 'visuals', 'parameters', 'ablations']) AS missing_field, doc_id FROM d
  UNION ALL SELECT 'limitations', doc_id FROM d WHERE doc_id NOT IN (SELECT doc_id FROM claims WHERE expected_kind = 'limitation'))
SELECT missing_field, count(*) AS n FROM g GROUP BY 1""",
    ),
    "section_numbers": (
        section_numbers,
        """WITH p AS (SELECT doc_id, ['reason', 'problem', 'insight', 'limits'] AS names, [n_chars % 2 = 0, n_chars % 3 = 0, true, lang = 'en'] AS ok FROM documents),
k AS (SELECT doc_id, list_filter([CASE WHEN ok[1] THEN names[1] END, CASE WHEN ok[2] THEN names[2] END, names[3], CASE WHEN ok[4] THEN names[4] END], lambda x: x IS NOT NULL) AS kept FROM p)
SELECT doc_id, array_to_string(list_transform(kept, lambda x, i: lpad(i::VARCHAR, 2, '0') || ' ' || x), '|') AS numbered FROM k""",
    ),
}
