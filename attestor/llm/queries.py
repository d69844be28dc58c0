"""The registered queries of the numbered problems, and their SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from attestor.llm import encode, groups, leaks, neighbours, pagebody, pii, residue, sitelines
from attestor.sources.tables import table


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return pagebody.furniture(table(spark, folder, "passages"), table(spark, folder, "fetches"), table(spark, folder, "sources"))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return groups.match_groups(table(spark, folder, "claims"), table(spark, folder, "claim_links"), table(spark, folder, "origins"))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return neighbours.similar_pairs(table(spark, folder, "claim_vectors"))


def p3_recall(spark: SparkSession, folder: str) -> DataFrame:
    """The routed search held against brute force, with many small partitions."""
    return neighbours.recall(table(spark, folder, "claim_vectors"))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return residue.residue(table(spark, folder, "passages"), table(spark, folder, "fetches"), table(spark, folder, "sources"))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return sitelines.repeated_lines(table(spark, folder, "passages"), table(spark, folder, "fetches"), table(spark, folder, "sources"))


def p6_ids(spark: SparkSession, folder: str) -> DataFrame:
    return encode.encode_documents(table(spark, folder, "documents"))


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return leaks.leaked_items(table(spark, folder, "documents"), table(spark, folder, "eval_items"))


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return pii.find_pii(table(spark, folder, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": p1_found,
    "p2_found": p2_found,
    "p3_found": p3_found,
    "p3_recall": p3_recall,
    "p4_found": p4_found,
    "p5_found": p5_found,
    "p6_ids": p6_ids,
    "p7_found": p7_found,
    "p8_found": p8_found,
}

_FINITE = "list_sum(list_transform(embedding, lambda x: case when isfinite(x) then 0 else 1 end)) = 0"

SQL: dict[str, str] = {
    "p2_found": """
with recursive pair as (select least(from_claim, to_claim) as a, greatest(from_claim, to_claim) as b, relation,
    row_number() over (partition by least(from_claim, to_claim), greatest(from_claim, to_claim)
      order by case method when 'human' then 1 when 'model' then 2 else 3 end, created_at desc, from_claim, relation desc) as n
  from claim_links where from_claim <> to_claim and method in ('human', 'model', 'rule')
    and from_claim in (select claim_id from claims) and to_claim in (select claim_id from claims)),
e as (select 'claim' as k, a, b from pair where n = 1 and relation = 'same' union select 'document', document_id, origin_id from origins where document_id <> origin_id),
both_ways as (select k, a, b from e union select k, b, a from e),
reach as (select k, a as id, a as seen from both_ways union select reach.k, id, b from reach join both_ways w on w.k = reach.k and w.a = reach.seen)
select k as record_kind, min(seen) as group_id, id as record_id from reach group by k, id""",
    "p3_found": f"""
with v as (select claim_id as id, embed_model as m, embedding::double[] as e from (select *, row_number() over (partition by claim_id order by embedded_at desc) as n from claim_vectors
   where embed_model is not null and embedding is not null and len(embedding) = 96 and {_FINITE} and list_sum(list_transform(embedding, lambda x: abs(x))) > 0) where n = 1),
s as (select q.id as q, v.id as o, round(list_cosine_similarity(q.e, v.e), 9) as sim from v q join v on v.m = q.m and v.id <> q.id),
r as (select *, row_number() over (partition by q order by sim desc, o) as n from s where sim >= 0.75)
select distinct least(q, o) as claim_a, greatest(q, o) as claim_b from r where n <= 5""",
    "p3_recall": f"""
select m as embed_model, count(*) as asked, true as recalled from (select claim_id, embed_model as m, row_number() over (partition by claim_id order by embedded_at desc) as n from claim_vectors
   where embed_model is not null and embedding is not null and len(embedding) = 96 and {_FINITE} and list_sum(list_transform(embedding, lambda x: abs(x))) > 0) where n = 1 and claim_id % 100 = 0 group by 1""",
    "p5_found": r"""
with site as (select f.document_id, regexp_replace(regexp_extract(lower(trim(s.url)), '^[a-z][a-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1), '^www\.', '') as site
   from (select document_id, min(source_id) as source_id from fetches where document_id is not null group by 1) f join sources s using (source_id)),
p as (select distinct passage_id, document_id, text from passages where text is not null),
l as (select passage_id, document_id, unnest(string_split(text, chr(10))) as line, unnest(range(len(string_split(text, chr(10))))) as line_no from p),
beside as (select passage_id, document_id, line_no, regexp_replace(lower(line), '(\d[.,]? ?)\b(SHORT)\b(\.?[ .,]*\d)', '\1 \3', 'g') as line from l),
k as (select passage_id, document_id, line_no, array_to_string(list_filter(regexp_split_to_array(line, '[^\p{L}\p{M}]+'), lambda w: w not in (MONTHS)), '') as key from beside),
j as (select k.*, site from k join site using (document_id) where key <> '' and site <> ''),
c as (select site, key from j group by 1, 2 having count(distinct document_id) >= 6)
select passage_id, line_no::int as line_no from j semi join c using (site, key)""".replace("SHORT", "|".join(sitelines.SHORT_MONTHS)).replace("MONTHS", ", ".join(f"'{m}'" for m in sitelines.MONTHS)),
}
