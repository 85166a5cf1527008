"""Fixed schemas of the relations that enter as files or model answers."""

from __future__ import annotations

from pyspark.sql import types as T

STRING, BIGINT, DOUBLE, BOOLEAN, TIMESTAMP = (
    T.StringType(), T.LongType(), T.DoubleType(), T.BooleanType(), T.TimestampType(),
)


def struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


def array(kind: T.DataType) -> T.ArrayType:
    return T.ArrayType(kind)


STRINGS = array(STRING)

COLLECTION = struct(key=STRING, name=STRING, parent_key=STRING)
LIBRARY_ITEM = struct(
    key=STRING, title=STRING, abstract=STRING, collection_keys=STRINGS, added_at=TIMESTAMP
)
METADATA_ENTRY = struct(
    arxiv_id=STRING, version=BIGINT, title=STRING, authors=STRINGS, abstract=STRING, categories=STRINGS,
    primary_category=STRING, published_at=TIMESTAMP, updated_at=TIMESTAMP, arxiv_url=STRING, pdf_url=STRING,
    code_url=STRING,
)
PREPRINT = struct(
    title=STRING, authors=STRING, abstract=STRING, doi=STRING, version=STRING, date=STRING, category=STRING
)
PREPRINT_RESPONSE = struct(collection=array(PREPRINT), messages=array(struct(status=STRING)))
OFFLINE_FIXTURE = struct(
    collections=array(COLLECTION), items=array(LIBRARY_ITEM), arxiv_entries=array(METADATA_ENTRY),
    embeddings=T.MapType(STRING, array(DOUBLE)), now=TIMESTAMP,
)
COMMAND = struct(
    command_id=STRING, paper_id=STRING, action=STRING, value=BOOLEAN, occurred_at=TIMESTAMP,
    device_id=STRING, sequence=BIGINT,
)
BUNDLE = struct(schema_version=STRING, bundle_id=STRING, generated_at=TIMESTAMP, commands=array(COMMAND), digest=STRING)

ATOM_ENTRY = struct(
    id=STRING, title=STRING, summary=STRING, published=STRING, updated=STRING,
    author=array(struct(name=STRING)),
    category=array(struct(_term=STRING)),
    link=array(struct(_href=STRING, _title=STRING, _type=STRING)),
    **{"arxiv:primary_category": struct(_term=STRING), "arxiv:announce_type": STRING, "_corrupt_record": STRING},
)

CLAIM = struct(
    claim_id=STRING, kind=STRING, text=STRING, source_type=STRING, inferred=BOOLEAN, evidence_ids=STRINGS,
    confidence=DOUBLE,
)
ANALYSIS = struct(
    paper_id=STRING, english_title=STRING,
    links=struct(pdf_url=STRING, arxiv_url=STRING, code_url=STRING),
    chinese_title=CLAIM, recommendation_reason=CLAIM, research_problem=CLAIM, insight_formation_logic=CLAIM,
    method_overview=CLAIM, differences_from_prior_work=CLAIM,
    insights=array(CLAIM),
    supporting_visuals=array(struct(evidence_id=STRING, insight_ids=STRINGS, support_explanation=CLAIM)),
    method_modules=array(struct(name=STRING, purpose=CLAIM)),
    parameters=array(struct(
        name=STRING, symbol=STRING, role=CLAIM, final_value=STRING, selection_method=STRING,
        per_model_tuning=BOOLEAN, evidence_ids=STRINGS, ablation_ids=STRINGS, source_type=STRING,
        inferred=BOOLEAN, confidence=DOUBLE,
    )),
    ablations=array(struct(
        ablation_id=STRING, parameter_names=STRINGS, conclusion=CLAIM, visual_evidence_ids=STRINGS
    )),
    experimental_conclusions=array(CLAIM),
    limitations=array(CLAIM),
)
PAGE_ROW = struct(
    path=STRING, pdf_page=BIGINT, width=DOUBLE, height=DOUBLE, text_chars=BIGINT, image_count=BIGINT
)
