"""The registered queries of the evidence engine and their SQL.

Each callable reads whole tables of a data folder.  SQL is given where SQL can
say the same; the others are tested against brute force in ``tests``.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timezone
from functools import cache

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from attestor.functions.dates import date_of, date_text, precision_of
from attestor.functions.identity import doi_of, domain_of, fetchable, hash63, on_domain, slug, source_kind, url_key
from attestor.functions.passages import passages as passages_of
from attestor.functions.passages import sentences
from attestor.functions.quotes import locate_quote
from attestor.functions.records import content_kind, document_quote
from attestor.functions.text import clean_text, informative, quote_key, share_term, words
from attestor.operators import joins, merge, ranking
from attestor.operators.components import components
from attestor.plans import claims as claim_plans
from attestor.plans import context, find, graph, origins, reports, store, work
from attestor.session import Scratch, spread
from attestor.sources import sinks
from attestor.sources.files import line_range
from attestor.sources.tables import table

FLAGSHIP = "hybrid_find"
NOW = datetime(2026, 12, 1, tzinfo=timezone.utc)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return f(cache(lambda name: table(spark, folder, name)))

        QUERIES[f.__name__] = run
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# ---------------------------------------------------------------- identity

@query(
    r"""
with k as (
  select source_id, url, url_key as stored, title, doi,
    regexp_replace(regexp_replace(lower(regexp_extract(trim(url), '^(?i:https?)://([^/?#\s]+)', 1)), ':(80|443)$', ''), '^www\.', '') as host,
    regexp_replace(regexp_extract(trim(url), '^(?i:https?)://[^/?#]+([^?#]*)', 1), '/+$', '') as path,
    array_to_string(list_sort(list_filter(string_split(regexp_extract(trim(url), '^[^?#]*\?([^#]*)', 1), '&'), lambda p: p <> '' and not regexp_matches(lower(p), '^(utm_[^=]*|fbclid|gclid|dclid|msclkid|mc_cid|mc_eid|igshid|_ga)(=|$)'))), '&') as q
  from sources),
n as (select source_id, stored, title, doi, host || path || case when q <> '' then '?' || q else '' end as key from k)
select source_id, key, key = stored as as_stored, regexp_extract(key, '^[^/?]*') as domain,
  (('0x' || substr(sha256(key), 1, 8))::bigint & 2147483647) * 4294967296 + ('0x' || substr(sha256(key), 9, 8))::bigint as key_id,
  case when doi is not null then 'paper' else 'web' end as kind,
  coalesce(nullif(regexp_replace(regexp_replace(lower(title), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), ''), 'unnamed') as slug
from n"""
)
def url_identity(t) -> DataFrame:
    """URL keys, their ids, domains, kinds and slugs of all sources."""
    k = t("sources").withColumn("key", url_key(F.col("url")))
    return k.select(
        "source_id", "key", (F.col("key") == F.col("url_key")).alias("as_stored"), domain_of(F.col("key")).alias("domain"), hash63(F.col("key")).alias("key_id"),
        source_kind(domain_of(F.col("key")), F.col("doi")).alias("kind"), slug(F.col("title")).alias("slug"),
    )


@query(
    r"""
with f as (select *, row_number() over (order by first_seen_at, url) as o from sources)
select url_key, arg_min(url, o) as url,
  arg_min(domain, o) filter (where domain is not null and domain <> '') as domain,
  arg_min(title, o) filter (where title is not null and title <> '') as title,
  coalesce(arg_min(kind, o) filter (where kind <> 'web'), 'web') as kind,
  arg_min(doi, o) filter (where doi is not null and doi <> '') as doi,
  strftime(min(first_seen_at), '%Y-%m-%d') as first_seen, strftime(max(last_seen_at), '%Y-%m-%d') as last_seen
from f group by url_key"""
)
def source_fold(t) -> DataFrame:
    """Sources folded by key, in whatever order they arrive."""
    f = merge.fold_sources(t("sources"))
    return f.select("url_key", "url", "domain", "title", "kind", "doi", F.date_format("first_seen_at", "yyyy-MM-dd").alias("first_seen"), F.date_format("last_seen_at", "yyyy-MM-dd").alias("last_seen"))


@query(
    r"""
with f as (select *, row_number() over (order by attempted_at, run_id, seq) as o from fetches where document_id is not null)
select document_id, min(source_id) as source_id,
  case when bool_and(coalesce(content_kind, '') = 'abstract') then 'abstract' else 'full' end as content_kind,
  arg_min(content_type, o) filter (where content_type is not null and content_type <> '') as content_type,
  arg_min(title, o) filter (where title is not null and title <> '') as title,
  arg_min(text_chars, o) filter (where text_chars is not null) as text_chars,
  strftime(min(attempted_at), '%Y-%m-%d') as first_fetched, strftime(max(attempted_at), '%Y-%m-%d') as last_fetched,
  arg_min(published, (case when coalesce(published_weak, false) then 1 else 0 end) * 1000000000 + o) filter (where published is not null) as published
from f group by document_id"""
)
def document_fold(t) -> DataFrame:
    """One row a document from its fetches, strong dates over weak ones."""
    d = merge.fold_documents(t("fetches"))
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    return d.select("document_id", "source_id", "content_kind", "content_type", "title", "text_chars", day("first_fetched_at").alias("first_fetched"), day("last_fetched_at").alias("last_fetched"), "published")


@query(
    r"""
with d as (select claim_id, any_value(as_of) as as_of from claims group by claim_id),
p as (select claim_id, as_of,
  case when regexp_matches(trim(as_of), '^\d{4}-\d{2}-\d{2}$') then try_cast(trim(as_of) as date)
       when regexp_matches(trim(as_of), '^\d{4}-\d{2}$') then try_cast(trim(as_of) || '-01' as date)
       when regexp_matches(trim(as_of), '^\d{4}$') then try_cast(trim(as_of) || '-01-01' as date) end as d from d)
select claim_id, as_of, strftime(d, '%Y-%m-%d') as day,
  case when d is null then null when length(trim(as_of)) = 10 then 'day' when length(trim(as_of)) = 7 then 'month' else 'year' end as precision,
  case when d is null then null else trim(as_of) end as written
from p"""
)
def as_of_dates(t) -> DataFrame:
    """Claims' dates with their precision, and back to text; no date stays null."""
    c = t("claims").groupBy("claim_id").agg(F.max("as_of").alias("as_of"))
    d, p = date_of(F.col("as_of")), precision_of(F.col("as_of"))
    return c.select("claim_id", "as_of", F.date_format(d, "yyyy-MM-dd").alias("day"), p.alias("precision"), date_text(d, p).alias("written"))


@query(
    r"""
select source_id, lower(regexp_extract(coalesce(doi, url), '(10\.\d{4,9}/[^\s?#&"<>]+)', 1)) as found,
  regexp_matches(url, '^(?i:https?)://[^/?#\s]+') and not lower(regexp_extract(regexp_replace(url, '[?#].*$', ''), '://[^/]+/.*\.([A-Za-z0-9]+)$', 1)) in
  ('jpg','jpeg','png','gif','webp','svg','ico','bmp','mp3','mp4','m4a','wav','avi','mov','webm','mkv','zip','gz','tar','rar','7z','exe','dmg','css','js','woff') as fetchable
from sources"""
)
def dois_and_fetchable(t) -> DataFrame:
    """DOIs in sources' links and whether a link can be fetched."""
    s = t("sources")
    return s.select("source_id", F.coalesce(doi_of(F.coalesce("doi", "url")), F.lit("")).alias("found"), fetchable(F.col("url")).alias("fetchable"))


# ---------------------------------------------------------------- store


@query("select 'claim_links' as name, count(*) as rows from claim_links union all select 'claims', count(*) from claims union all select 'fetches', count(*) from fetches union all select 'passages', count(*) from passages union all select 'sources', count(*) from sources")
def index_counts(t) -> DataFrame:
    return store.row_counts({n: t(n) for n in ("sources", "fetches", "passages", "claims", "claim_links")})


@query(
    """
with c as (select distinct claim_id, quote_verified from claims),
 v as (select distinct claim_id from claim_vectors where embedding is not null),
 e as (select from_claim as claim_id from claim_links union select to_claim from claim_links)
select count(*) as claims, count(*) filter (where not quote_verified) as unverified,
  count(*) filter (where claim_id not in (select claim_id from v)) as unembedded,
  count(*) filter (where claim_id not in (select claim_id from e)) as unlinked,
  (select count(*) from claim_links) as link_lines, (select count(*) from claim_links where method = 'model') as model_lines,
  (select count(*) from claim_links where method = 'human') as human_lines from c"""
)
def claim_counts(t) -> DataFrame:
    return store.claim_counts(t("claims"), t("claim_vectors"), t("claim_links"))


_F = "f as (select * from (select *, row_number() over (partition by run_id, seq) as _d from fetches) where _d = 1)"
_CLASS = "case when http_status between 200 and 399 and error is null then 'ok' when http_status in (401, 403, 429, 999) then 'blocked' when http_status in (404, 410) or regexp_matches(coalesce(error, ''), '(?i)no such host|nxdomain') then 'dead' else 'error' end"


@query(f"with {_F} select run_id, count(*) filter (where c = 'ok') as ok, count(*) filter (where c = 'blocked') as blocked, count(*) filter (where c = 'dead') as dead, count(*) filter (where c = 'error') as error from (select run_id, {_CLASS} as c from f) group by run_id")
def fetch_classes(t) -> DataFrame:
    """Fetch outcomes per run, zeros included."""
    return store.class_counts(t("fetches"))


@query(f"with {_F} select source_id, run_id, seq, reason from (select *, row_number() over (partition by source_id order by run_id, seq) as r from f) where r = 1")
def first_sighting(t) -> DataFrame:
    return store.first_sightings(t("fetches"))


@query(f"with {_F} select source_id, run_id, seq, document_id, attempts from (select *, row_number() over (partition by source_id order by document_id is not null desc, attempted_at desc, seq desc, run_id) as r from f) where r = 1")
def best_attempt(t) -> DataFrame:
    f = store.deliveries(t("fetches"))
    order = [F.col("document_id").isNotNull().desc(), F.desc("attempted_at"), F.desc("seq"), F.col("run_id")]
    return ranking.best_per(f, ["source_id"], order).select("source_id", "run_id", "seq", "document_id", "attempts")


@query(
    f"""
with {_F}, p as (select document_id, count(*) as passages from (select distinct passage_id, document_id from passages) group by 1),
 seen as (select run_id, source_id, count(*) as tried, min(seq) as first_seq, list_sort(list(distinct seq))[1:5] as seqs from f group by 1, 2),
 best as (select run_id, source_id, document_id, {_CLASS} as outcome from (select *, row_number() over (partition by run_id, source_id order by document_id is not null desc, attempted_at desc, seq desc) as r from f) where r = 1)
select seen.run_id, seen.source_id, url_key, title, tried, first_seq, array_to_string(seqs, ',') as seqs, best.document_id, outcome, coalesce(passages, 0) as passages
from seen join best using (run_id, source_id) join sources using (source_id) left join p on p.document_id = best.document_id"""
)
def run_sources(t) -> DataFrame:
    """What each run tried of each source and what came of it."""
    return store.run_sources(t("fetches"), t("sources"), t("passages"))


@query(
    """
with p as (select distinct passage_id, document_id, ord, char_start, char_end from passages)
select *, coalesce(lag(passage_id) over w::varchar, '') as before, coalesce(lead(passage_id) over w::varchar, '') as after from p window w as (partition by document_id order by ord)"""
)
def passage_neighbours(t) -> DataFrame:
    return store.passage_cards(t("passages"), 1)


@query(
    f"""
with {_F}, done as (select distinct document_id from claims)
select text_sha256, max(title) as title, max(text_chars) as chars, bool_or(reason = 'cited') as cited, strftime(max(attempted_at), '%Y-%m-%d') as last_fetched
from f where document_id is not null and text_sha256 is not null and document_id not in (select document_id from done)
group by 1 having max(text_chars) >= 200"""
)
def claim_candidates(t) -> DataFrame:
    c = store.claim_candidates(t("fetches"), t("claims"))
    return c.withColumn("last_fetched", F.date_format("last_fetched_at", "yyyy-MM-dd")).drop("last_fetched_at")


@query(
    f"""
with {_F}, r as (select *, case reason when 'cited' then 1 when 'opened' then 2 when 'result' then 3 else 4 end as p, coalesce(hit_rank, 2147483647) as hit from f),
 b as (select run_id, source_id, reason, hit, min(seq) over (partition by run_id, source_id) as first_seq, row_number() over (partition by run_id, source_id order by p, hit, reason) as n from r)
select run_id, source_id, reason, nullif(hit, 2147483647) as hit_rank, first_seq from b where n = 1 and source_id not in (select source_id from f where document_id is not null)"""
)
def fetch_plan(t) -> DataFrame:
    return store.fetch_plan(t("fetches"))


@query(
    """
with f as (select run_id, seq, count(*) as n, min(document_id) as d, min(attempted_at) as a0 from fetches group by 1, 2),
 p as (select run_id, count(distinct passage_id) as passages from passages group by 1)
select f.run_id, count(*) as fetches, count(*) filter (where d is null) as failed, sum(n - 1)::bigint as repeats, max(seq) - min(seq) + 1 - count(*) as gaps,
 strftime(min(a0), '%Y-%m-%d') as oldest, strftime(max(a0), '%Y-%m-%d') as newest, coalesce(any_value(passages), 0) as passages
from f left join p using (run_id) group by f.run_id"""
)
def run_health(t) -> DataFrame:
    return store.run_health(t("fetches"), t("passages"))


@query(
    """
select severity, message, n from (
 select 'error' as severity, 'claims of passages that are not there' as message, (select count(*) from claims where passage_id not in (select passage_id from passages)) as n
 union all select 'error', 'links to claims that are not there', (select count(*) from (select from_claim as c from claim_links union all select to_claim from claim_links) where c not in (select claim_id from claims))
 union all select 'warning', 'claims whose quote is not verified', (select count(*) from claims where not quote_verified)
 union all select 'warning', 'sources without a document', (select count(*) from sources where source_id not in (select source_id from fetches where document_id is not null))
 union all select 'warning', 'links of a claim to itself', (select count(*) from claim_links where from_claim = to_claim)
 union all select 'note', 'fetches delivered more than once', (select count(*) from (select run_id, seq from fetches group by 1, 2 having count(*) > 1))
) where n > 0"""
)
def store_problems(t) -> DataFrame:
    return store.problems({n: t(n) for n in ("claims", "passages", "claim_links", "sources", "fetches")})


# ---------------------------------------------------------------- claims

_REL = """
rel as (select least(from_claim, to_claim) as a, greatest(from_claim, to_claim) as b, from_claim, to_claim, relation, method, created_at,
   row_number() over (partition by least(from_claim, to_claim), greatest(from_claim, to_claim)
     order by case method when 'human' then 1 when 'model' then 2 when 'rule' then 3 else 4 end, created_at desc, from_claim, to_claim desc, relation desc) as n
 from claim_links where from_claim <> to_claim)"""


@query(f"with {_REL} select a, b, from_claim, to_claim, relation, method from rel where n = 1")
def claim_relations(t) -> DataFrame:
    """The link that holds between each two claims."""
    return claim_plans.claim_relations(t("claim_links")).drop("created_at")


@query(
    r"""
select from_claim, to_claim, method, relation, nullif(model, '') as model, round(nullif(confidence, 0)::double, 4) as confidence, nullif(note, '') as note, epoch_us(created_at) as created_us
from (select *, row_number() over (partition by from_claim, to_claim, method order by created_at desc, relation desc, model desc nulls last, confidence desc nulls last, note desc nulls last) as n from claim_links) where n = 1"""
)
def link_log(t) -> DataFrame:
    """The append-only link log folded to its newest lines."""
    l = merge.latest_links(t("claim_links"))
    return l.withColumn("confidence", F.round(F.col("confidence").cast("double"), 4)).withColumn("created_us", F.unix_micros("created_at")).drop("created_at")


_DATED = r"""
docs as (select document_id, arg_min(published, (case when coalesce(published_weak, false) then 1 else 0 end) * 1000000000 + o) filter (where published is not null) as published,
   min(attempted_at)::date as collected, max(attempted_at)::date as confirmed
  from (select *, row_number() over (order by attempted_at, run_id, seq) as o from fetches where document_id is not null) group by 1),
roots as (select document_id, min(origin_id) as origin_id from origins group by 1),
one as (select claim_id, any_value(document_id) as document_id, any_value(as_of) as as_of, any_value(volatile) as volatile from claims group by 1),
parsed as (select one.*, published, collected, confirmed, coalesce(origin_id, one.document_id) as own_origin,
  case when regexp_matches(trim(as_of), '^\d{4}(-\d{2}){0,2}$') then try_cast(rpad(trim(as_of), 10, '-01-01'[length(trim(as_of)) - 3 + 0:1] || '') as date) end as x
  from one join docs using (document_id) left join roots using (document_id)),
known as (select *, coalesce(
   case when regexp_matches(trim(as_of), '^\d{4}-\d{2}-\d{2}$') then try_cast(trim(as_of) as date) when regexp_matches(trim(as_of), '^\d{4}-\d{2}$') then try_cast(trim(as_of) || '-01' as date) when regexp_matches(trim(as_of), '^\d{4}$') then try_cast(trim(as_of) || '-01-01' as date) end,
   case when regexp_matches(trim(published), '^\d{4}-\d{2}-\d{2}$') then try_cast(trim(published) as date) when regexp_matches(trim(published), '^\d{4}-\d{2}$') then try_cast(trim(published) || '-01' as date) when regexp_matches(trim(published), '^\d{4}$') then try_cast(trim(published) || '-01-01' as date) end,
   collected) as dated from one2)"""
# the dated claims, without the scratch column
_DATED = _DATED.replace(_DATED[_DATED.index("parsed as (") : _DATED.index("known as (")], "one2 as (select one.*, published, collected, confirmed, coalesce(origin_id, one.document_id) as own_origin from one join docs using (document_id) left join roots using (document_id)),\n")
_DIRECTED = """
live as (select * from rel where n = 1 and relation <> 'unrelated'),
dir as (select from_claim as claim_id, to_claim as other_id, relation from live
  union all select to_claim, from_claim, case relation when 'refines' then 'refined_by' when 'supersedes' then 'superseded_by' else relation end from live)"""


_FLAGGED = """
cl as (select d.claim_id, list(distinct o.own_origin) filter (where relation in ('same', 'supports')) as so,
  max(o.dated) filter (where relation in ('same', 'supports')) as sl, min(o.dated) filter (where relation in ('same', 'supports')) as sf,
  max(o.confirmed) filter (where relation in ('same', 'supports')) as sc, max(o.dated) filter (where relation = 'contradicts') as al,
  count(*) filter (where relation = 'contradicts') as nc, count(*) filter (where relation = 'superseded_by') as ns, count(*) as related
  from dir d join known o on o.claim_id = d.other_id group by 1),
j as (select k.*, so, sl, sf, sc, al, nc, ns, related, greatest(dated, coalesce(sl, dated)) as last, least(dated, coalesce(sf, dated)) as first,
   len(list_distinct(list_concat(coalesce(so, []), [own_origin]))) as origins from known k left join cl using (claim_id)),
flagged as (select claim_id, document_id, origins, coalesce(related, 0) as related, strftime(dated, '%Y-%m-%d') as dated,
  case when year(first) <> year(last) then year(first)::varchar || '-' || year(last)::varchar end as support_dates,
  strftime(greatest(confirmed, coalesce(sc, confirmed)), '%Y-%m-%d') as last_confirmed,
  case when origins >= 2 then 'reinforced' else 'single_origin' end || case when coalesce(nc, 0) > 0 then ',contested' else '' end
   || case when al > last then ',newer_contradiction' else '' end || case when coalesce(ns, 0) > 0 then ',superseded' else '' end
   || case when volatile and date '2026-12-01' - last > 30 then ',possibly_outdated' else '' end as flags
from j)"""
_NEAR = """
shown as (select d.claim_id, d.relation || ' ' || d.other_id::varchar || ' ' || strftime(k.dated, '%Y-%m-%d') as line,
  row_number() over (partition by d.claim_id order by list_position(['superseded_by', 'contradicts', 'same', 'supports', 'refined_by', 'refines', 'supersedes'], d.relation), k.dated desc, d.other_id) as r
  from dir d join known k on k.claim_id = d.other_id),
near as (select claim_id, string_agg(line, '; ' order by r) as related from shown where r <= 20 group by 1)"""


@query(f"with {_REL}, {_DIRECTED}, {_DATED}, {_FLAGGED} select * from flagged")
def claim_flags(t) -> DataFrame:
    """Every claim's one-hop cluster and its flags."""
    return claim_plans.claim_flags(t("claims"), t("claim_links"), merge.fold_documents(t("fetches")), t("origins"), NOW)


@query(
    f"""
with {_REL}, {_DIRECTED}, {_DATED},
seeds as (select distinct claim_id from claims where volatile and quote_verified),
ids as (select claim_id, bool_or(m) as matched from (select claim_id, true as m from seeds union all select other_id, false from dir where claim_id in (select claim_id from seeds)) group by 1),
ch as (select case when relation = 'contradicts' and b.dated > a.dated then to_claim else from_claim end as claim_id,
   relation || ' ' || (case when relation = 'contradicts' and b.dated > a.dated then from_claim else to_claim end)::varchar || ' (' || strftime(case when relation = 'contradicts' and b.dated > a.dated then a.dated else b.dated end, '%Y-%m-%d') || ')' as change
  from live join ids i on i.claim_id = from_claim join ids i2 on i2.claim_id = to_claim join known a on a.claim_id = from_claim join known b on b.claim_id = to_claim where relation in ('supersedes', 'refines', 'contradicts')),
g as (select claim_id, array_to_string(list_sort(list(distinct change)), '; ') as changes from ch group by 1)
select strftime(dated, '%Y-%m-%d') as dated, known.claim_id, matched, coalesce(changes, '') as changes from known join ids using (claim_id) left join g on g.claim_id = known.claim_id"""
)
def claim_timeline(t) -> DataFrame:
    """All volatile verified claims and their relatives by date."""
    seeds = t("claims").where("volatile and quote_verified")
    return claim_plans.timeline(seeds, t("claims"), t("claim_links"), merge.fold_documents(t("fetches")), t("origins"))


_QUOTED = r"""
c as (select claim_id, any_value(document_id) as document_id, any_value(extracted_at) as extracted_at,
   trim(regexp_replace(lower(any_value(quote)), '[^\p{L}\p{Nd}]+', ' ', 'g')) as k from claims where quote_verified and claim_id is not null group by 1),
 w as (select * from c where len(string_split(k, ' ')) >= 6)"""


@query(
    f"""
with {_QUOTED}, h as (select k, arg_min(claim_id, claim_id) as head, arg_min(document_id, claim_id) as hd from w group by 1),
 o as (select w.k, min(w.claim_id) as other from w join h using (k) where w.document_id <> h.hd group by 1),
 x as (select w.claim_id as a, w.extracted_at as e, case when w.document_id = hd then other else head end as b from w join h using (k) join o using (k))
select distinct least(a, b) as from_claim, greatest(a, b) as to_claim, 'same' as relation, 'rule' as method, epoch_us(greatest(e, w.extracted_at)) as created_us from x join w on w.claim_id = x.b"""
)
def rule_links(t) -> DataFrame:
    """Links by equal verified quotes: each claim to the smallest one of another document, or to the quote's first."""
    return claim_plans.rule_links(t("claims")).withColumn("created_us", F.unix_micros("created_at")).drop("created_at")


@query(
    f"""
with recursive {_QUOTED}, e as (select x.claim_id as a, y.claim_id as b from w x join w y on x.k = y.k and x.document_id <> y.document_id),
 reach as (select a, b from e union select reach.a, e.b from reach join e on e.a = reach.b)
select a as claim_id, least(a, min(b)) as group_id, (select count(*) from e where e.a = reach.a) as links from reach group by a"""
)
def rule_groups(t) -> DataFrame:
    """Groups of the rule links by components, and how many partners each claim has in all pairs."""
    links = claim_plans.rule_links(t("claims"))
    scratch = Scratch(links.sparkSession, "rules")
    roots = components(links.select(F.col("from_claim").alias("a"), F.col("to_claim").alias("b")), scratch)
    return claim_plans.rule_groups(t("claims")).drop("group_id").join(roots.select(F.col("id").alias("claim_id"), F.col("root").alias("group_id")), "claim_id")


@query(
    """
with c as (select claim_id, any_value(document_id) as document_id, any_value(char_start) as char_start from claims group by 1),
 p as (select distinct passage_id, document_id, ord, char_start, char_end from passages)
select c.claim_id, c.document_id, c.char_start, arg_min(p.passage_id, p.ord) as found_passage
from c left join p on p.document_id = c.document_id and c.char_start >= p.char_start and c.char_start < p.char_end group by 1, 2, 3"""
)
def claim_passages(t) -> DataFrame:
    """The passage each claim's quote starts in (null in a gap or without a place)."""
    c = t("claims").dropDuplicates(["claim_id"]).select("claim_id", "document_id", "char_start")
    p = t("passages").dropDuplicates(["passage_id"]).select("document_id", "passage_id", "ord", F.col("char_start").alias("start"), F.col("char_end").alias("stop"))
    hit = joins.point_in_span(c, p, ["document_id"], "char_start", "start", "stop", "ord")
    return hit.select("claim_id", "document_id", "char_start", F.col("span_passage_id").alias("found_passage"))


@query()
def quote_anchors(t) -> DataFrame:
    """Claims' quotes located in their passages, as offsets into the document."""
    c = t("claims").dropDuplicates(["claim_id"]).select("claim_id", "passage_id", "quote", "quote_verified", "char_start", "char_end")
    p = t("passages").dropDuplicates(["passage_id"]).select("passage_id", "text", F.col("char_start").alias("base"))
    at = c.join(p, "passage_id").withColumn("at", locate_quote(F.col("quote"), F.col("text")))
    return at.select("claim_id", "quote_verified", "char_start", "char_end", (F.col("base") + F.col("at.char_start")).alias("found_start"), (F.col("base") + F.col("at.char_end")).alias("found_end"))


def _nearest(t, only: DataFrame | None = None) -> DataFrame:
    """The 20 nearest of every claim whose id is divisible by 100, among all claims or those of ``only``."""
    v = F.col("embedding")
    ok = v.isNotNull() & (F.size(v) == 96) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x)) & F.exists(v, lambda x: x != 0)
    rows = t("claim_vectors").where(ok)
    rows = rows if only is None else rows.join(only, "claim_id", "left_semi")
    rows = rows.groupBy("claim_id").agg(F.max_by(F.struct("embed_model", "embedding"), "embedded_at").alias("x"))
    rows = rows.select(F.col("claim_id").alias("id"), F.col("x.embed_model").alias("model"), F.col("x.embedding").alias("v"))
    return joins.nearest_of_some(rows, rows.where("id % 100 = 0"), 20)


@query(
    """
with v as (select claim_id as id, embed_model as model, embedding::double[] as e from (select *, row_number() over (partition by claim_id order by embedded_at desc) as n from claim_vectors
   where embedding is not null and len(embedding) = 96 and not list_contains(list_transform(embedding, lambda x: isnan(x)), true) and list_sum(list_transform(embedding, lambda x: x * x)) > 0) where n = 1),
 s as (select q.id as query_id, v.id, round(list_cosine_similarity(q.e, v.e), 9) as sim from v q join v on v.model = q.model and v.id <> q.id where q.id % 100 = 0),
 r as (select *, row_number() over (partition by query_id order by sim desc, id) as rank from s)
select query_id, id, round(sim, 6) as similarity, rank from r where rank <= 20"""
)
def nearest_claims(t) -> DataFrame:
    """Exactly the 20 nearest claims of every claim whose id is divisible by 100."""
    near = _nearest(t)
    near = ranking.cap_per(near, ["query_id"], [F.desc("similarity"), F.col("id")], 20, "rank")
    return near.withColumn("similarity", F.round("similarity", 6))


_NEAREST = """
v as (select claim_id as id, embed_model as model, embedding::double[] as e from (select *, row_number() over (partition by claim_id order by embedded_at desc) as n from claim_vectors
   where embedding is not null and len(embedding) = 96 and not list_contains(list_transform(embedding, lambda x: isnan(x)), true) and list_sum(list_transform(embedding, lambda x: x * x)) > 0) where n = 1
   and claim_id in (select claim_id from claims where quote_verified)),
 s as (select q.id as query_id, v.id, round(list_cosine_similarity(q.e, v.e), 9) as sim from v q join v on v.model = q.model and v.id <> q.id where q.id % 100 = 0),
 n20 as (select *, row_number() over (partition by query_id order by sim desc, id) as r from s qualify r <= 20)"""


@query(
    f"""
with {_NEAREST}, o as (select document_id, min(origin_id) as root from origins group by 1),
 c as (select claim_id, coalesce(root, document_id) as root from (select claim_id, any_value(document_id) as document_id from claims where quote_verified group by 1) left join o using (document_id)),
 p as (select query_id as claim_id, id as near_id, sim from n20 join c a on a.claim_id = query_id join c b on b.claim_id = id where a.root <> b.root and sim >= 0.75
   and not exists (select 1 from claim_links l where (l.from_claim = query_id and l.to_claim = id) or (l.from_claim = id and l.to_claim = query_id)))
select claim_id, near_id, round(sim, 6) as similarity, row_number() over (partition by claim_id order by sim desc, near_id) as rank from p qualify rank <= 5"""
)
def linking_neighbours(t) -> DataFrame:
    """Of every asked claim's nearest ones the first five of another origin, close enough and without a link (ids divisible by 100 against all)."""
    near = _nearest(t, t("claims").where("quote_verified").select("claim_id").distinct())
    out = work.new_neighbours(near, t("claims"), t("claim_links"), t("origins"))
    return out.withColumn("similarity", F.round("similarity", 6))


@query(
    f"""
with {_REL}, {_DIRECTED}, d as (select claim_id, any_value(document_id) as document_id from claims group by 1)
select least(x.document_id, y.document_id) as a, greatest(x.document_id, y.document_id) as b
from live join d x on x.claim_id = live.a join d y on y.claim_id = live.b where relation = 'same' and x.document_id <> y.document_id group by 1, 2 having count(*) >= 2"""
)
def same_claim_documents(t) -> DataFrame:
    return origins.same_claims(t("claims"), t("claim_links"))


@query(
    f"""
with recursive {_REL}, {_DIRECTED}, dd as (select claim_id, any_value(document_id) as document_id from claims group by 1),
f as (select document_id, source_id, lower(doi) as doi,
   regexp_replace(regexp_replace(lower(regexp_extract(trim(final_url), '^(?i:https?)://([^/?#\\s]+)', 1)), ':(80|443)$', ''), '^www\\.', '') || regexp_replace(regexp_extract(trim(final_url), '^(?i:https?)://[^/?#]+([^?#]*)', 1), '/+$', '')
   || coalesce('?' || nullif(array_to_string(list_sort(list_filter(string_split(regexp_extract(trim(final_url), '^[^?#]*\\?([^#]*)', 1), '&'), lambda p: p <> '' and not regexp_matches(lower(p), '^(utm_[^=]*|fbclid|gclid|dclid|msclkid|mc_cid|mc_eid|igshid|_ga)(=|$)'))), '&'), ''), '') as fk
  from fetches where document_id is not null),
pairs as (select least(x.document_id, y.document_id) as a, greatest(x.document_id, y.document_id) as b from live join dd x on x.claim_id = live.a join dd y on y.claim_id = live.b
   where relation = 'same' and x.document_id <> y.document_id group by 1, 2 having count(*) >= 2),
e as (select x.document_id as a, y.document_id as b from f x join f y on x.source_id = y.source_id union select x.document_id, y.document_id from f x join f y on x.fk = y.fk and x.fk <> ''
   union select x.document_id, y.document_id from f x join f y on x.doi = y.doi union select a, b from pairs union select b, a from pairs),
r as (select document_id as id, document_id as root from f union select r.id, e.b from r join e on e.a = r.root)
select id as document_id, min(root) as origin_id from r group by 1"""
)
def origin_roots(t) -> DataFrame:
    """Independent origins of documents by source, final URL, DOI and shared claims."""
    return origins.origin_groups(t("fetches"), t("claims"), t("claim_links")).drop("reason")


@query()
def origin_reasons(t) -> DataFrame:
    """Origins with reasons, near-duplicate texts included (hashed passage by passage)."""
    return origins.origin_groups(t("fetches"), t("claims"), t("claim_links"), t("passages"))


@query()
def near_copies(t) -> DataFrame:
    """Documents with a near copy: one row each with its class of equal hashes, the smallest near copy and how many links."""
    return origins.near_links(t("documents"), "doc_id", "text")


@query("select sha256(text) as sha, min(doc_id) as first_doc, count(*) as copies from documents where text is not null group by 1 having count(*) > 1")
def exact_copies(t) -> DataFrame:
    d = t("documents").where("text is not null").groupBy(F.sha2("text", 256).alias("sha")).agg(F.min("doc_id").alias("first_doc"), F.count("*").alias("copies"))
    return d.where("copies > 1")


# ---------------------------------------------------------------- retrieval

_Q = "harbour ledger of the tide survey"
_TERMS = "('harbour', 'ledger', 'tide', 'survey')"
_W = r"list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{Nd}]+'), lambda x: x <> '')"


@query(
    rf"""
with p as (select distinct passage_id, text from passages), s as (select passage_id, len(list_filter({_W}, lambda x: x in {_TERMS})) as hits from p)
select passage_id, hits, row_number() over (order by hits desc, passage_id) as rank from s where hits > 0 qualify rank <= 50"""
)
def text_top(t) -> DataFrame:
    """The 50 passages with most occurrences of a query's words."""
    a = find.text_arm(t("passages"), find.Query(_Q, now=NOW), "passage_id")
    return a.select(F.col("id").alias("passage_id"), F.col("text_hits").alias("hits"), F.col("text_rank").alias("rank"))


@query(
    rf"""
with w as (select doc_id, {_W} as w from documents where text is not null)
select doc_id, len(w) as words, case when len(w) < 40 then 1.0 else round(greatest(0.2, least(1.0, len(list_distinct(w)) / len(w) / 0.25)), 6) end as informative from w"""
)
def informative_score(t) -> DataFrame:
    d = t("documents").where("text is not null")
    return d.select("doc_id", F.size(words(F.col("text"))).alias("words"), F.round(informative(F.col("text")), 6).alias("informative"))


def _documents(t) -> DataFrame:
    """One row a document with its site."""
    site = t("sources").select("source_id", domain_of(F.col("url_key")).alias("site"))
    return merge.fold_documents(t("fetches")).join(site, "source_id", "left").withColumn("origin", F.lit("primary"))


_FIND = rf"""
vone as (select claim_id, any_value(document_id) as document_id, any_value(text) as text, any_value(as_of) as as_of, any_value(volatile) as volatile from claims where quote_verified group by 1),
vdocs as (select document_id, arg_min(published, (case when coalesce(published_weak, false) then 1 else 0 end) * 1000000000 + o) filter (where published is not null) as published,
   arg_min(title, o) filter (where title is not null and title <> '') as title, min(source_id) as source_id, min(attempted_at)::date as collected
  from (select *, row_number() over (order by attempted_at, run_id, seq) as o from fetches where document_id is not null) group by 1),
q as (select arg_min(embedding, claim_id)::double[] as v from claim_vectors where embed_model = 'sprat-embed-v2' and len(embedding) = 96 and not list_contains(list_transform(embedding, lambda x: isnan(x)), true) and list_sum(list_transform(embedding, lambda x: x * x)) > 0),
pt as (select passage_id as id, row_number() over (order by hits desc, passage_id) as text_rank from (select passage_id, len(list_filter({_W}, lambda x: x in {_TERMS})) as hits from (select distinct passage_id, text from passages)) where hits > 0 qualify text_rank <= 50),
ct as (select claim_id as id, row_number() over (order by hits desc, claim_id) as text_rank from (select claim_id, len(list_filter({_W}, lambda x: x in {_TERMS})) as hits from vone) where hits > 0 qualify text_rank <= 50),
cv as (select id, round(s, 9) as s, row_number() over (order by round(s, 9) desc, id) as vector_rank from (select claim_id as id, max(list_cosine_similarity(embedding::double[], (select v from q))) as s from claim_vectors
   where embed_model = 'sprat-embed-v2' and len(embedding) = 96 and not list_contains(list_transform(embedding, lambda x: isnan(x)), true) and list_sum(list_transform(embedding, lambda x: x * x)) > 0 and claim_id in (select claim_id from vone) group by 1) where s >= 0.5 qualify vector_rank <= 50),
cards as (select 'passage' as kind, p.passage_id as id, p.document_id, p.text, null as as_of, false as volatile, text_rank, null::bigint as vector_rank, null::double as s from pt join (select distinct passage_id, document_id, text from passages) p on p.passage_id = pt.id
  union all select 'claim', vone.claim_id, vone.document_id, vone.text, vone.as_of, vone.volatile, text_rank, vector_rank, s from (select coalesce(ct.id, cv.id) as id, text_rank, vector_rank, s from ct full join cv on ct.id = cv.id) m join vone on vone.claim_id = m.id),
scored as (select cards.*, title, (coalesce(1 / (60.0::double + text_rank), 0) + coalesce(1 / (60.0::double + vector_rank), 0))
   * case when kind = 'claim' or len({_W}) < 40 then 1.0::double else greatest(0.2::double, least(1.0::double, len(list_distinct({_W})) / len({_W}) / 0.25::double)) end
   * case when volatile then pow(0.5::double, (date '2026-12-01' - coalesce(
      case when regexp_matches(trim(as_of), '^\d{{4}}-\d{{2}}-\d{{2}}$') then try_cast(trim(as_of) as date) when regexp_matches(trim(as_of), '^\d{{4}}-\d{{2}}$') then try_cast(trim(as_of) || '-01' as date) when regexp_matches(trim(as_of), '^\d{{4}}$') then try_cast(trim(as_of) || '-01-01' as date) end,
      case when regexp_matches(trim(published), '^\d{{4}}-\d{{2}}-\d{{2}}$') then try_cast(trim(published) as date) when regexp_matches(trim(published), '^\d{{4}}-\d{{2}}$') then try_cast(trim(published) || '-01' as date) when regexp_matches(trim(published), '^\d{{4}}$') then try_cast(trim(published) || '-01-01' as date) end,
      collected)) / 365.0::double) else 1.0::double end as raw from cards join vdocs using (document_id)),
capped as (select *, row_number() over (partition by document_id, kind order by round(raw, 12) desc, kind, id) as n from scored),
picked as (select * from capped where n <= 2 order by round(raw, 12) desc, kind, id limit 20),
gone as (select d.claim_id from dir d join picked a on a.kind = 'claim' and a.id = d.claim_id join picked b on b.kind = 'claim' and b.id = d.other_id where d.relation = 'superseded_by'),
kept as (select * from picked where kind <> 'claim' or id not in (select claim_id from gone) order by round(raw, 12) desc, kind, id limit 10)"""


@query(
    f"""
with {_REL}, {_DIRECTED}, {_DATED}, {_FLAGGED}, {_NEAR}, {_FIND}
select kind, id, kept.document_id, title, round(raw, 6) as score, round(s, 4) as similarity, text_rank, vector_rank, flagged.flags, near.related
from kept left join flagged on kind = 'claim' and flagged.claim_id = id left join near on kind = 'claim' and near.claim_id = id"""
)
def hybrid_find(t) -> DataFrame:
    """The flagship: text and vector arms over passages and claims, fused, discounted and capped."""
    v = t("claim_vectors").where((F.col("embed_model") == "sprat-embed-v2") & (F.size("embedding") == 96) & ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x)) & F.exists("embedding", lambda x: x != 0))
    first = v.agg(F.min_by("embedding", "claim_id").alias("v")).first()  # the query vector: one row
    q = find.Query(_Q, limit=10, vector=tuple(first.v or ()), embed_model="sprat-embed-v2", min_similarity=0.5, now=NOW)
    docs = Scratch(v.sparkSession, "documents").save(_documents(t))  # in a store they are a table
    return find.find(q, t("passages"), t("claims"), v, docs, t("claim_links"), t("origins")).drop("site", "age", "text")


@query(
    rf"""
with q as (select item_id as query_id, list_filter(list_distinct(regexp_split_to_array(lower(string_split(text, chr(10))[-1]), '[^\p{{L}}\p{{Nd}}]+')), lambda x: x <> '' and x not in ({', '.join(f"'{w}'" for w in find.STOP)})) as terms from eval_items where text is not null),
w as (select passage_id, unnest({_W}) as word from (select distinct passage_id, text from passages where text is not null)),
tf as (select passage_id, word, count(*) as n from w group by 1, 2),
h as (select query_id, passage_id, sum(n)::bigint as hits from (select query_id, unnest(terms) as word from q) t join tf using (word) group by 1, 2)
select query_id, passage_id, hits, row_number() over (partition by query_id order by hits desc, passage_id) as rank from h qualify rank <= 10"""
)
def batch_find(t) -> DataFrame:
    """Ten best passages for every test item's question, all passages read once."""
    q = t("eval_items").select(F.col("item_id").alias("query_id"), F.element_at(F.split("text", "\n"), -1).alias("text"))
    return find.batch_find(t("passages"), q, 10)


@query(
    r"""
with l as (select from_claim as a, to_claim as b from claim_links where from_claim < to_claim group by 1, 2), c as (select claim_id, any_value(text) as text from claims group by 1),
 t as (select claim_id, list_filter(list_distinct(regexp_split_to_array(lower(text), '[^\p{L}\p{Nd}]+')), lambda x: (strlen(x) >= 4 or regexp_matches(x, '\p{Nd}')) and x not in ('that', 'this', 'with', 'from', 'have', 'been', 'were', 'which', 'their', 'there', 'they', 'than', 'also', 'into', 'more', 'most', 'such', 'some', 'other', 'about', 'after', 'before', 'over', 'under', 'when', 'what', 'where', 'while', 'these', 'those', 'would', 'could', 'should', 'will', 'each', 'only', 'many', 'much', 'very', 'between', 'through', 'during', 'because', 'does', 'said', 'says', 'them', 'then', 'upon', 'within', 'without', 'across', 'among', 'being', 'both', 'even', 'like', 'made', 'make', 'same', 'well')) as w from c)
select a, b, len(list_intersect(x.w, y.w)) > 0 as shared from l join t x on x.claim_id = a join t y on y.claim_id = b"""
)
def shared_terms(t) -> DataFrame:
    """Linked claims and whether they share a telling word."""
    l = t("claim_links").where("from_claim < to_claim").select(F.col("from_claim").alias("a"), F.col("to_claim").alias("b")).distinct()
    c = t("claims").groupBy("claim_id").agg(F.min("text").alias("text"))
    j = l.join(c.select(F.col("claim_id").alias("a"), F.col("text").alias("ta")), "a").join(c.select(F.col("claim_id").alias("b"), F.col("text").alias("tb")), "b")
    return j.select("a", "b", share_term(F.col("ta"), F.col("tb")).alias("shared"))


@query(r"select claim_id, nullif(trim(regexp_replace(lower(any_value(quote)), '[^\p{L}\p{Nd}]+', ' ', 'g')), '') as quote_key from claims where quote is not null group by claim_id")
def quote_keys(t) -> DataFrame:
    c = t("claims").where("quote is not null").groupBy("claim_id").agg(F.min("quote").alias("quote"))
    return c.select("claim_id", quote_key(F.col("quote")).alias("quote_key"))


# ---------------------------------------------------------------- documents and reports


@query()
def split_passages(t) -> DataFrame:
    """Documents cut into passages with exact offsets."""
    d = spread(t("documents").where("text is not null").select("doc_id", "text")).select("doc_id", F.explode(passages_of(F.col("text"))).alias("p"))
    return d.select("doc_id", "p.ord", "p.char_start", "p.char_end", F.sha2("p.text", 256).alias("sha"))


@query()
def sentence_counts(t) -> DataFrame:
    d = spread(t("documents").where("text is not null").select("doc_id", "text"))
    return d.select("doc_id", F.size(sentences(F.col("text"))).alias("sentences"))


@query()
def citation_check(t) -> DataFrame:
    """Reports' citation marks checked against fetches of their run, passages, claims and sources, with their quotes' states."""
    r = t("documents").where("content_kind = 'report'")
    m = Scratch(r.sparkSession, "marks").save(reports.marks(r.withColumn("doc_id", F.struct("doc_id", "run_id"))).select("doc_id.*", "ord", "kind", "target", "group_ord", "quote"))
    targets = reports.citation_targets(m, t("fetches"), t("passages"), t("claims"), t("sources"))
    scoped = m.withColumn("run_id", F.when(F.col("kind") == "E", F.col("run_id")).otherwise(""))
    return reports.citation_summary(reports.check_marks(scoped, targets, ("run_id",), ("E", "P", "C", "S")), "doc_id")


@query(
    r"""
with m as (select doc_id, unnest(regexp_extract_all(text, '\[(?:E\d+|[PCS]:\d+)\]')) as mark from documents where text is not null and content_kind = 'report')
select doc_id, count(*) filter (where mark like '[E%') as evidence, count(*) filter (where mark like '[P%') as passages, count(*) filter (where mark like '[S%') as sources, count(*) as marks from m group by 1"""
)
def citation_kinds(t) -> DataFrame:
    m = reports.marks(t("documents").where("content_kind = 'report'"))
    count = lambda k: F.count_if(F.col("kind") == k)
    return m.groupBy("doc_id").agg(count("E").alias("evidence"), count("P").alias("passages"), count("S").alias("sources"), F.count("*").alias("marks"))


@query()
def report_metrics(t) -> DataFrame:
    return reports.report_metrics(reports.parsed_reports(t("documents").where("content_kind in ('report', 'draft')")))


@query()
def arm_rollup(t) -> DataFrame:
    parsed = reports.parsed_reports(t("documents").where("content_kind in ('report', 'draft')"))
    return reports.arm_rollup(Scratch(parsed.sparkSession, "reports").save(parsed))


@query(
    """
with d as (select doc_id, source, octet_length(encode(text)) as n from documents where text is not null and source is not null),
 r as (select *, coalesce(sum(n) over (partition by source order by doc_id rows between unbounded preceding and 1 preceding), 0) as used from d)
select doc_id, source, used::bigint as used_before, least(n, 120000 - used)::bigint as granted from r where used < 120000"""
)
def evidence_budget(t) -> DataFrame:
    """Per source the documents that fit 120,000 bytes, the crossing one in part."""
    d = t("documents").where("text is not null and source is not null").select("doc_id", "source", F.octet_length("text").cast("long").alias("n"))
    return ranking.within_budget(d, ["source"], [F.col("doc_id")], F.col("n"), 120_000).drop("n")


@query(
    """
with d as (select doc_id, run_id, coalesce(n_chars, 0)::bigint as need from documents where run_id is not null),
 r as (select *, row_number() over w as k, count(*) over (partition by run_id) as n, coalesce(sum(need) over (partition by run_id order by need, md5(doc_id::varchar || chr(0) || run_id), doc_id rows between unbounded preceding and 1 preceding), 0) as b
   from d window w as (partition by run_id order by need, md5(doc_id::varchar || chr(0) || run_id), doc_id)),
 x as (select *, max(case when need * (n - k + 1) > 50000 - b then 1 else 0 end) over (partition by run_id order by k rows unbounded preceding) as short from r),
 s as (select run_id, min(k) as k0, min(b) as b0 from x where short = 1 group by 1)
select x.doc_id, x.run_id, x.need, case when short = 0 then need else ((50000 - b0 + k - k0) // (n - k0 + 1))::bigint end as share from x left join s using (run_id)"""
)
def fair_shares(t) -> DataFrame:
    """Per run 50,000 characters shared fairly among its documents."""
    d = t("documents").where("run_id is not null").select("doc_id", "run_id", F.coalesce("n_chars", F.lit(0)).alias("need"))
    return ranking.fair_shares(d, ["run_id"], "need", 50_000)


@query(
    """
with d as (select doc_id, content_kind, coalesce(lang, '?') as lang from documents where text is not null),
 r as (select *, row_number() over (partition by content_kind, lang order by md5(doc_id::varchar || ' 11'), doc_id) as round from d),
 p as (select *, row_number() over (partition by content_kind order by round, lang) as pick from r where round <= 20)
select doc_id, content_kind, lang, pick from p where pick <= 20"""
)
def review_sample(t) -> DataFrame:
    """Twenty reports per content kind, round-robin over languages, in seeded order."""
    d = t("documents").where("text is not null").select("doc_id", "content_kind", F.coalesce("lang", F.lit("?")).alias("lang"))
    return ranking.stratified_sample(d, "content_kind", "lang", "doc_id", 20, 11)


# ---------------------------------------------------------------- graph


@query("select p_partkey as part, cited from (select l_partkey as p_partkey, count(distinct l_orderkey) as cited from lineitem group by 1)")
def cited_by_counts(t) -> DataFrame:
    """How many distinct orders reference each part."""
    return graph.cited_by(t("lineitem").select(F.col("l_orderkey").alias("from_id"), F.col("l_partkey").alias("to_id")), "part", "cited")


@query("with c as (select l_suppkey as id, count(distinct l_orderkey) as cited from lineitem group by 1) select s_suppkey as id, s_name as title, cited from supplier join c on c.id = s_suppkey where cited >= 25")
def cited_by_min(t) -> DataFrame:
    """Suppliers that at least 25 distinct orders reference."""
    nodes = t("supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("title"))
    edges = t("lineitem").select(F.col("l_orderkey").alias("from_id"), F.col("l_suppkey").alias("to_id"))
    return graph.cited_at_least(nodes, edges, 25)


@query(
    r"""
with d as (select doc_id, unnest(regexp_extract_all(text, 'https?://[^\s<>"''`\]\[{}|\\^]+')) as raw from documents where text is not null),
u as (select doc_id, regexp_replace(raw, '[.,;:!?*_''"]+$', '') as url0 from d),
v as (select doc_id, case when url0 like '%)' and len(url0) - len(replace(url0, ')', '')) > len(url0) - len(replace(url0, '(', '')) then regexp_replace(url0, '[).,;:!?*_''"]+$', '') else url0 end as url from u),
k as (select doc_id, url, regexp_replace(regexp_replace(lower(regexp_extract(url, '^https?://([^/?#]+)', 1)), ':(80|443)$', ''), '^www\.', '') || regexp_replace(regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1), '/+$', '')
   || coalesce('?' || nullif(array_to_string(list_sort(list_filter(string_split(regexp_extract(url, '^[^?#]*\?([^#]*)', 1), '&'), lambda p: p <> '' and not regexp_matches(lower(p), '^(utm_[^=]*|fbclid|gclid|dclid|msclkid|mc_cid|mc_eid|igshid|_ga)(=|$)'))), '&'), ''), '') as key from v where len(url) > 8)
select key, min(url) as url, count(distinct doc_id) as cited from k group by 1"""
)
def bibliography(t) -> DataFrame:
    """Reports' listed URLs as a graph of references: how many reports cite each page."""
    return graph.bibliography(t("documents"))


@query(
    """
with e as (select user_id, ts, event_id, event_type, lag(event_type) over (partition by user_id order by ts, event_id) as previous, row_number() over (partition by user_id order by ts, event_id) as n from events)
select user_id, event_id, event_type, previous from e where n = 1 or previous is distinct from event_type"""
)
def status_changes(t) -> DataFrame:
    """Each user's events that differ from the one before."""
    return ranking.transitions(t("events"), ["user_id"], ["ts", "event_id"], "event_type", F.to_date("ts")).select("user_id", "event_id", "event_type", "previous")


@query(
    """
with e as (select user_id, ts, event_id, value, lag(ts) over (partition by user_id order by ts, event_id) as p from events),
 g as (select *, sum(case when p is null or ts - p > interval 30 minute then 1 else 0 end) over (partition by user_id order by ts, event_id rows unbounded preceding) as session from e)
select user_id, session::bigint as session, count(*) as events, round(sum(value), 4) as value from g group by 1, 2"""
)
def event_sessions(t) -> DataFrame:
    """Users' events grouped by gaps of more than half an hour."""
    new = F.col("ts") - F.col("prev_ts") > F.expr("interval 30 minutes")
    g = ranking.groups_by_gap(t("events"), ["user_id"], ["ts", "event_id"], new, ["ts"], F.to_date("ts"), "session")
    return g.groupBy("user_id", "session").agg(F.count("*").alias("events"), F.round(F.sum("value"), 4).alias("value"))


@query("select k, event_type, count(*) as n, round(avg(value), 6) as mean from (select cast(json_extract(props, '$.k') as bigint) as k, event_type, value from events) group by 1, 2")
def event_properties(t) -> DataFrame:
    """JSON properties of events, read with a schema."""
    e = t("events").select(F.from_json("props", "k bigint").alias("p"), "event_type", "value")
    return e.groupBy(F.col("p.k").alias("k"), "event_type").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"))


# ---------------------------------------------------------------- records


@query(
    r"""
with d as (select document_id, content_type from (select *, row_number() over (partition by document_id order by attempted_at, run_id, seq) as n from fetches where document_id is not null) where n = 1)
select document_id, case when lower(trim(split_part(coalesce(content_type, ''), ';', 1))) = 'application/pdf' then 'pdf' when lower(trim(split_part(coalesce(content_type, ''), ';', 1))) in ('text/html', 'application/xhtml+xml') then 'html'
  when lower(trim(split_part(coalesce(content_type, ''), ';', 1))) like 'text/%' then 'text' else 'other' end as kind from d"""
)
def content_kinds(t) -> DataFrame:
    """Each document's kind by its first fetch's media type."""
    f = ranking.best_per(t("fetches").where("document_id is not null"), ["document_id"], [F.col("attempted_at"), F.col("run_id"), F.col("seq")])
    return f.select("document_id", content_kind(F.col("content_type"), F.lit(None).cast("string")).alias("kind"))


@query(
    """
with c as (select distinct claim_id, document_id, passage_id, quote, quote_verified, char_start, char_end from claims), p as (select distinct passage_id, text, char_start as base from passages)
select claim_id, case when quote_verified then case when char_start is not null and char_start - base >= 0 and char_end > char_start and char_end - base <= length(text) then substr(text, char_start - base + 1, char_end - char_start) else quote end end as quote
from c join p using (passage_id)"""
)
def claim_quotes(t) -> DataFrame:
    """Verified claims' quotes as their documents have them."""
    c = t("claims").dropDuplicates(["claim_id"]).select("claim_id", "passage_id", "quote", "quote_verified", "char_start", "char_end")
    p = t("passages").dropDuplicates(["passage_id"]).select("passage_id", "text", F.col("char_start").alias("base"))
    q = document_quote(F.col("text"), F.col("char_start") - F.col("base"), F.col("char_end") - F.col("base"), F.col("quote"), F.col("quote_verified"))
    return c.join(p, "passage_id").select("claim_id", q.alias("quote"))


@query(
    """
with c as (select distinct claim_id, document_id, quote_verified, extracted_at from claims where quote_verified), v as (select distinct claim_id from claim_vectors where embedding is not null),
 e as (select from_claim as claim_id from claim_links union select to_claim from claim_links)
select claim_id, document_id, epoch_us(extracted_at) as extracted_us from c where claim_id in (select claim_id from v) and claim_id not in (select claim_id from e)"""
)
def unchecked_claims(t) -> DataFrame:
    """Verified claims with a vector that no link has touched yet."""
    c = t("claims").where("quote_verified").dropDuplicates(["claim_id"])
    v = t("claim_vectors").where("embedding is not null").select("claim_id").distinct()
    e = t("claim_links").select(F.explode(F.array("from_claim", "to_claim")).alias("claim_id")).distinct()
    out = c.join(v, "claim_id", "left_semi").join(e, "claim_id", "left_anti")
    return out.select("claim_id", "document_id", F.unix_micros("extracted_at").alias("extracted_us"))


@query(
    f"""
with {_F} select s.source_id, s.url_key, count(f.seq) as attempts, count(distinct f.document_id) as documents, count(distinct f.run_id) as runs,
  count(distinct case when f.reason = 'cited' then f.run_id end) as citing_runs, strftime(max(f.attempted_at), '%Y-%m-%d') as last_attempt
from sources s left join f using (source_id) group by 1, 2"""
)
def source_lookup(t) -> DataFrame:
    """Every source with its attempts, documents and the runs that cite it."""
    f = store.deliveries(t("fetches")).groupBy("source_id").agg(
        F.count("*").alias("attempts"), F.count_distinct("document_id").alias("documents"), F.count_distinct("run_id").alias("runs"), F.count_distinct(F.when(F.col("reason") == "cited", F.col("run_id"))).alias("citing_runs"),
        F.date_format(F.max("attempted_at"), "yyyy-MM-dd").alias("last_attempt"),
    )
    return t("sources").select("source_id", "url_key").join(f, "source_id", "left").fillna(0, ["attempts", "documents", "runs", "citing_runs"])


@query(
    f"""
with {_F}, v as (select source_id, document_id, min(attempted_at) as first_at, any_value(text_sha256) as sha from f where document_id is not null group by 1, 2)
select source_id, document_id, strftime(first_at, '%Y-%m-%d') as first_fetched, row_number() over (partition by source_id order by first_at desc, document_id) as version from v"""
)
def document_versions(t) -> DataFrame:
    """Documents of each source, the newest first."""
    v = store.deliveries(t("fetches")).where("document_id is not null").groupBy("source_id", "document_id").agg(F.min("attempted_at").alias("first_at"))
    w = Window.partitionBy("source_id").orderBy(F.desc("first_at"), "document_id")
    return v.select("source_id", "document_id", F.date_format("first_at", "yyyy-MM-dd").alias("first_fetched"), F.row_number().over(w).alias("version"))


@query(
    """
with o as (select document_id, min(origin_id) as origin_id from origins group by 1), c as (select claim_id, any_value(document_id) as document_id from claims group by 1)
select coalesce(origin_id, c.document_id) as origin, count(*) as claims, count(distinct c.document_id) as documents from c left join o using (document_id) group by 1"""
)
def origin_claims(t) -> DataFrame:
    """Claims and documents of each independent origin."""
    o = t("origins").groupBy("document_id").agg(F.min("origin_id").alias("origin_id"))
    c = t("claims").groupBy("claim_id").agg(F.min("document_id").alias("document_id"))
    return c.join(o, "document_id", "left").groupBy(F.coalesce("origin_id", "document_id").alias("origin")).agg(F.count("*").alias("claims"), F.count_distinct("document_id").alias("documents"))


@query("select doc_id, substr(text, 201, 500) as slice, length(text) > 700 as truncated from documents where text is not null")
def document_slices(t) -> DataFrame:
    """Characters 200 to 700 of every document and whether more follows."""
    s = store.document_slice(F.col("text"), 200, 500)
    return t("documents").where("text is not null").select("doc_id", s["text"].alias("slice"), s["truncated"].alias("truncated"))


@query(
    """
with p as (select distinct passage_id, document_id, text_sha256 from passages)
select text_sha256, count(*) as passages, count(distinct document_id) as documents, min(passage_id) as first_passage from p group by 1 having count(distinct document_id) > 1"""
)
def shared_passages(t) -> DataFrame:
    """Passage texts that several documents share, by content hash."""
    p = t("passages").dropDuplicates(["passage_id"]).groupBy("text_sha256").agg(F.count("*").alias("passages"), F.count_distinct("document_id").alias("documents"), F.min("passage_id").alias("first_passage"))
    return p.where("documents > 1")


@query("select o_orderpriority as arm, count(*) as calls, round(sum(o_totalprice), 2) as cost, count(*) filter (where o_orderstatus = 'F') as errors from orders group by 1")
def call_totals(t) -> DataFrame:
    """Per arm: calls, cost and errors (orders stand in for a call log)."""
    return t("orders").groupBy(F.col("o_orderpriority").alias("arm")).agg(F.count("*").alias("calls"), F.round(F.sum("o_totalprice"), 2).alias("cost"), F.count_if(F.col("o_orderstatus") == "F").alias("errors"))


# ---------------------------------------------------------------- more of the store's questions


@query(f"with {_REL}, {_DIRECTED}, {_DATED}, {_NEAR} select claim_id, related from near")
def claim_clusters(t) -> DataFrame:
    """Every linked claim's relatives in order, twenty at most."""
    known = claim_plans.dated_claims(t("claims"), _documents(t), t("origins"))
    return claim_plans.related_in_order(claim_plans.directed(claim_plans.claim_relations(t("claim_links"))), known, 20)


@query(
    r"""
with m as (select doc_id, unnest(regexp_extract_all(text, '\[(?:E\d+|[PCS]:\d+)\]')) as mark, unnest(range(len(regexp_extract_all(text, '\[(?:E\d+|[PCS]:\d+)\]')))) as ord from documents where content_kind = 'report' and text is not null),
k as (select doc_id, mark, min(ord) as ord, mark[2:2] as kind, try_cast(regexp_extract(mark, '\d+') as bigint) as target from m group by doc_id, mark),
p as (select distinct passage_id, document_id from passages), c as (select claim_id, any_value(passage_id) as passage_id from claims group by 1),
j as (select doc_id, ord, mark, coalesce(p.passage_id, c.passage_id) as passage_id, kind from k left join p on kind = 'P' and p.passage_id = target left join c on kind = 'C' and c.claim_id = target where kind in ('P', 'C')),
r as (select j.*, row_number() over (partition by doc_id order by ord, mark) as n from j join p using (passage_id))
select doc_id, ord, mark[2:-2] as marker, passage_id from r where n <= 50"""
)
def cited_evidence(t) -> DataFrame:
    """The passages that reports' first fifty P and C marks show to a critic."""
    found = reports.marks(t("documents").where("content_kind = 'report'"))
    cards = t("passages").dropDuplicates(["passage_id"]).select("passage_id", "document_id", F.col("passage_id").cast("string").alias("text"), *[F.lit("x").alias(c) for c in ("site", "title", "age", "kind")])
    shown = reports.cited_evidence(found, cards, t("claims").withColumn("flags", F.lit("")))
    return shown.select("doc_id", "ord", "marker", F.regexp_extract("content", r"(\d+)$", 1).cast("long").alias("passage_id"))


@query(
    f"""
with {_F}, s as (select run_id, seq, source_id, any_value(attempted_at) as met from fetches group by 1, 2, 3)
select source_id, run_id, seq, row_number() over (partition by source_id order by met desc, run_id desc, seq desc) as rank from s qualify rank <= 20"""
)
def latest_sightings(t) -> DataFrame:
    """Where each source was last met, by run and number (fetches stand for sightings and their captures)."""
    f = store.deliveries(t("fetches"))
    seen = f.select("run_id", "seq", "source_id", F.lit(0).alias("ord"))
    out = store.latest_sightings(seen, f.select("run_id", "seq", F.col("attempted_at").alias("captured_at")))
    return out.select("source_id", "run_id", "seq", "rank")


@query("select distinct document_id from fetches where document_id is not null and document_id not in (select document_id from origins)")
def ungrouped_documents(t) -> DataFrame:
    return store.ungrouped_documents(merge.fold_documents(t("fetches")).withColumn("origin", F.lit("primary")), t("origins"))


@query(
    """
with e as (select distinct from_claim, to_claim, relation from claim_links), n as (select claim_id, any_value(text) as text, any_value(extractor) as x from claims group by 1),
s as (select from_claim as node_id, 'outgoing' as direction, relation, to_claim as other_id from e union all select to_claim, 'incoming', relation, from_claim from e)
select node_id, direction, relation as type, other_id, text as other_title, x as other_type from s left join n on claim_id = other_id"""
)
def described_edges(t) -> DataFrame:
    """Links of claims from both ends, with what stands at the other."""
    e = t("claim_links").select(F.col("from_claim").alias("from_id"), F.col("to_claim").alias("to_id"), F.col("relation").alias("type")).distinct()
    n = t("claims").groupBy("claim_id").agg(F.min("text").alias("title"), F.min("extractor").alias("type")).withColumnRenamed("claim_id", "id")
    return graph.described_edges(e, n)


@query(
    """
with s as (select source_id, url_key, first_seen_at, row_number() over (partition by url_key order by first_seen_at, source_id) as n from sources where doi is null),
 k as (select url_key from sources where doi is not null)
select url_key as key, source_id as node_id from s where n = 1 and url_key not in (select url_key from k)"""
)
def adopted_keys(t) -> DataFrame:
    """Keys that sources without one take (those with a DOI have theirs already)."""
    s = t("sources").select(F.col("source_id").alias("id"), F.lit("source").alias("type"), "url", F.col("first_seen_at").alias("created_at"), "url_key", "doi")
    known = s.where("doi is not null").select(F.col("url_key").alias("key"), F.col("id").alias("node_id"))
    return graph.adopted_keys(s.drop("url_key", "doi"), known)


@query(
    r"""
with e as (select url_key as key, f.run_id as book, f.seq as pos, f.via as author, f.content_kind as kind, f.published as date, f.title as note from (select *, row_number() over (partition by run_id, seq) as _d from fetches) f join sources using (source_id) where _d = 1),
a as (select key, arg_min(trim(author), (book, pos)) filter (where trim(coalesce(author, '')) <> '') as author, arg_min(trim(kind), (book, pos)) filter (where trim(coalesce(kind, '')) <> '') as kind,
  arg_min(trim(date), (book, pos)) filter (where trim(coalesce(date, '')) <> '') as date, list_sort(list(distinct book)) as books from e group by 1),
n as (select key, book, trim(note) as note, min(pos) as pos from e where trim(coalesce(note, '')) <> '' group by 1, 2, 3),
m as (select key, string_agg(book || '=' || note, '|' order by book, pos, note) as notes from n group by 1)
select s.url_key as key, author, a.kind, date, array_to_string(coalesce(books, []), ',') as books, coalesce(notes, '') as notes, coalesce(len(books), 0) > 0 as changed
from (select distinct url_key from sources) s left join a on a.key = s.url_key left join m on m.key = s.url_key"""
)
def merged_metadata(t) -> DataFrame:
    """What the runs' fetches say of each source, merged into its metadata (runs stand for books)."""
    f = store.deliveries(t("fetches")).join(t("sources").select("source_id", F.col("url").alias("source_url")), "source_id")
    entries = f.select(F.col("run_id").alias("book"), F.col("seq").alias("pos"), F.col("source_url").alias("url"), F.col("via").alias("author"), F.col("content_kind").alias("type"), F.col("published").alias("date"), F.col("title").alias("notes"))
    empty = [F.lit(None).cast(k).alias(c) for c, k in (("author", "string"), ("kind", "string"), ("date", "string"), ("books", "array<string>"), ("notes", "map<string,array<string>>"))]
    m = graph.merged_metadata(t("sources").select(F.col("url_key").alias("key")).distinct().select("key", *empty), entries)
    notes = F.flatten(F.transform(F.array_sort(F.map_entries("notes")), lambda e: F.transform(e["value"], lambda n: F.concat(e["key"], F.lit("="), n))))
    return m.select("key", "author", "kind", "date", F.array_join("books", ",").alias("books"), F.array_join(notes, "|").alias("notes"), "changed")


@query(
    rf"""
with d as (select document_id, min(source_id) as source_id, min(attempted_at) as at, arg_min(published, (case when coalesce(published_weak, false) then 1 else 0 end) * 1000000000 + o) filter (where published is not null) as published
  from (select *, row_number() over (order by attempted_at, run_id, seq) as o from fetches where document_id is not null) group by 1),
x as (select document_id, regexp_extract(url_key, '^[^/?]*') as site,
  case when regexp_matches(trim(published), '^\d{{4}}-\d{{2}}-\d{{2}}$') then try_cast(trim(published) as date) when regexp_matches(trim(published), '^\d{{4}}-\d{{2}}$') then try_cast(trim(published) || '-01' as date) when regexp_matches(trim(published), '^\d{{4}}$') then try_cast(trim(published) || '-01-01' as date) end as day
  from d join sources using (source_id)),
ok as (select document_id from x where day >= date '2015-01-01' and day <= date '2024-12-31'),
p as (select distinct passage_id, document_id, text from passages where document_id in (select document_id from ok)),
h as (select passage_id, document_id, len(list_filter({_W}, lambda x: x in {_TERMS})) as hits, {_W} as w from p),
r as (select *, row_number() over (order by hits desc, passage_id) as text_rank from h where hits > 0 qualify text_rank <= 100),
s as (select *, 1 / (60.0::double + text_rank) * case when len(w) < 40 then 1.0::double else greatest(0.2::double, least(1.0::double, len(list_distinct(w)) / len(w) / 0.25::double)) end as raw from r),
c as (select *, row_number() over (partition by document_id order by round(raw, 12) desc, passage_id) as n from s)
select passage_id as id, document_id, round(raw, 6) as score, text_rank from c where n <= 2 order by round(raw, 12) desc, passage_id limit 20"""
)
def dated_find(t) -> DataFrame:
    """A text query over passages of documents published from 2015 to 2024."""
    q = find.Query(_Q, limit=20, kinds=("passage",), since=datetime(2015, 1, 1), until=datetime(2024, 12, 31), now=NOW)
    docs = Scratch(t("passages").sparkSession, "documents").save(_documents(t))
    return find.find(q, t("passages"), t("claims"), t("claim_vectors"), docs).select("id", "document_id", "score", "text_rank")


@query(
    rf"""
select passage_id, hits, row_number() over (order by hits desc, passage_id) as rank from (select passage_id, len(list_filter({_W}, lambda x: x in {_TERMS})) as hits from (select distinct passage_id, text from passages)) where hits > 0 qualify rank <= 50"""
)
def term_top(t) -> DataFrame:
    """The same ranking from a term table of all passages: a query reads its words' rows and no text."""
    terms = find.term_table(t("passages"))
    a = find.term_arm(terms, find.Query(_Q, now=NOW))
    return a.select(F.col("id").alias("passage_id"), F.col("text_hits").alias("hits"), F.col("text_rank").alias("rank"))


@query(
    """
with v as (select claim_id, max(embed_model) filter (where embedding is not null) as m from claim_vectors group by 1), c as (select distinct claim_id from claims)
select claim_id from c left join v using (claim_id) where m is null or m <> 'sprat-embed-v2'"""
)
def not_embedded(t) -> DataFrame:
    """Claims without a vector of the current model."""
    v = t("claim_vectors").where("embedding is not null").groupBy("claim_id").agg(F.max("embed_model").alias("embed_model"), F.lit(1).alias("embedding"))
    return merge.not_embedded(t("claims").select("claim_id").distinct().join(v, "claim_id", "left"), "sprat-embed-v2").select("claim_id")


@query(
    """
select from_claim, to_claim, relation, method, count(*) as lines from claim_links where from_claim is not null and to_claim is not null and from_claim <> 0 and to_claim <> 0 and from_claim <> to_claim
 and relation in ('same', 'supports', 'contradicts', 'refines', 'supersedes', 'unrelated') and method in ('model', 'human') group by 1, 2, 3, 4"""
)
def valid_links(t) -> DataFrame:
    """Links that may go into the log."""
    return merge.valid_links(t("claim_links")).groupBy("from_claim", "to_claim", "relation", "method").agg(F.count("*").alias("lines"))


@query(
    """
with top as (select run_id, max(seq) as m from fetches group by 1), d as (select doc_id, run_id, collected_at from documents where run_id is not null)
select doc_id, run_id, coalesce(m, 0) + row_number() over (partition by d.run_id order by collected_at, doc_id) as seq from d left join top using (run_id)"""
)
def numbered_documents(t) -> DataFrame:
    """Documents numbered on behind their run's fetches."""
    d = t("documents").where("run_id is not null").select("doc_id", "run_id", "collected_at")
    return sinks.numbered(d, t("fetches").select("run_id", "seq"), "run_id", ["collected_at", "doc_id"]).drop("collected_at")


@query(
    """
with f as (select *, row_number() over (partition by document_id order by attempted_at, run_id, seq) as a, row_number() over (partition by document_id order by attempted_at desc, run_id desc, seq desc) as z from fetches where document_id is not null),
 k as (select document_id, text_sha256, raw_bytes from f where a = 1), s as (select document_id, text_sha256, raw_bytes from f where z = 1)
select s.document_id, s.text_sha256, s.raw_bytes from s join k using (document_id) where s.text_sha256 is distinct from k.text_sha256 or s.raw_bytes is distinct from k.raw_bytes"""
)
def changed_documents(t) -> DataFrame:
    """Documents whose last fetch differs from their first."""
    f = t("fetches").where("document_id is not null")
    order = [F.col("attempted_at"), F.col("run_id"), F.col("seq")]
    cols = ["document_id", "text_sha256", "raw_bytes"]
    first = ranking.best_per(f, ["document_id"], order).select(*cols)
    last = ranking.best_per(f, ["document_id"], [o.desc() for o in order]).select(*cols)
    return merge.changed(first, last, "document_id", ["text_sha256", "raw_bytes"])


@query(
    """
select source as shard, count(*) as captured, sum(length(text))::bigint as captured_chars, count(*) filter (where length(text) >= 1000) as passed, coalesce(sum(length(text)) filter (where length(text) >= 1000), 0)::bigint as passed_chars
from documents where text is not null and source is not null group by 1"""
)
def evidence_ledger(t) -> DataFrame:
    """Per source what was captured and what of it passed on (texts of 1,000 characters or more)."""
    d = t("documents").where("text is not null and source is not null")
    return context.ledger(d.select(F.col("source").alias("shard"), "text", (F.length("text") >= 1000).alias("passed")))


@query(
    r"""
select doc_id, sha256(regexp_replace(regexp_replace(regexp_replace(replace(text, chr(0), ''), '[ \t\n\x0B\f\r]*\f[ \t\n\x0B\f\r]*', chr(10) || chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^[ \t\n\x0B\f\r]+|[ \t\n\x0B\f\r]+$', '', 'g')) as sha from documents where text is not null"""
)
def clean_texts(t) -> DataFrame:
    """Documents' texts made clean, by their hash."""
    return t("documents").where("text is not null").select("doc_id", F.sha2(clean_text(F.col("text")), 256).alias("sha"))


@query("select doc_id, substr(array_to_string(string_split(text, chr(10))[2:4], chr(10)), 1, 100000) as lines from documents where text is not null")
def line_ranges(t) -> DataFrame:
    """Lines 2 to 4 of every document."""
    return t("documents").where("text is not null").select("doc_id", line_range(F.col("text"), 2, 4).alias("lines"))


@query(
    """
with a as (select distinct claim_id from claims), e as (select from_claim as claim_id from claim_links where method = 'model' union select to_claim from claim_links where method = 'model')
select claim_id, case when claim_id in (select claim_id from e) then '2026-12-01' end as checked from a"""
)
def checked_claims(t) -> DataFrame:
    """Claims marked as checked where a model has looked at their links."""
    e = t("claim_links").where("method = 'model'").select(F.explode(F.array("from_claim", "to_claim")).alias("claim_id"))
    c = work.mark_checked(t("claims").select("claim_id").distinct(), e, NOW)
    return c.select("claim_id", F.date_format("link_checked_at", "yyyy-MM-dd").alias("checked"))


@query(
    """
with s as (select source_id, domain from sources), w as (select source_id, domain, regexp_replace(regexp_extract(lower(url), '^https?://([^/?#:]+)', 1), '^www[.]', '') as host from sources)
select host, count(*) as sources from w where host = 'example' or host like '%.example' group by 1"""
)
def sources_on_domain(t) -> DataFrame:
    """Sources of one domain and its subdomains, by host."""
    s = t("sources").select(domain_of(url_key(F.col("url"))).alias("host"))
    return s.where(on_domain(F.col("host"), "www.example")).groupBy("host").agg(F.count("*").alias("sources"))
