"""Queries over the bridged events and the generic tables, each with the SQL it equals."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lineagram.bridge import PROV_SQL, prov_events
from lineagram.functions import scalars as fn
from lineagram.operators import graph, hsg, links, noise, paths, state, windows
from lineagram.operators.rules import DEMO_RULES, MATCH_SQL, matches, rule_table
from lineagram.session import cut
from lineagram.sources import logs

Query = Callable[[SparkSession, str], DataFrame]
CATALOG: dict[str, Query] = {}
SQL: dict[str, str] = {}

WITH_PROV = f"with recursive prov as ({PROV_SQL})"
WITH_MATCH = f"{WITH_PROV}, matched as ({MATCH_SQL})"
FLOW_SQL = """
  , moved as (select *, case when op in ('read', 'exec', 'recv') then object else subject end as src, case when op in ('read', 'exec', 'recv') then subject else object end as dst from prov)
"""
VERSION_SQL = f"""{FLOW_SQL}
  , touched as (select host, seq, entity, max(bump) as bump from (
      select host, seq, subject as entity, (op in ('read', 'recv') or dst = subject)::int as bump from moved
      union all select host, seq, object, (op in ('write', 'modify') or dst = object)::int from moved) group by all)
  , versioned as (select *, cast(1 + coalesce(sum(bump) over (partition by host, entity order by seq rows between unbounded preceding and 1 preceding), 0) as int) as before from touched)
  , stepped as (select *, cast(before + bump as int) as after from versioned)
"""


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        CATALOG[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = matches(prov_events(spark, sf_dir), DEMO_RULES)
    return hsg.with_ids(found.join(F.broadcast(rule_table(spark, DEMO_RULES)), "rule_id"))  # at most rules.MOST_RULES rows


# ---- events and scalars


@query(f"{WITH_PROV} select seq, ts, host, subject, op, object, bytes from prov")
def scan_events(spark, sf_dir):
    return prov_events(spark, sf_dir)


@query(f"{WITH_PROV} {FLOW_SQL} select seq, src, dst from moved")
def flow_direction(spark, sf_dir):
    return graph.flow(prov_events(spark, sf_dir)).select("seq", "src", "dst")


@query(
    f"""{WITH_PROV} select entity, lower(split_part(entity, ':', 1)) as prefix, substr(entity, position(':' in entity) + 1) as payload,
    case lower(split_part(entity, ':', 1)) when 'proc' then 'process' when 'reg' then 'registry' else lower(split_part(entity, ':', 1)) end as kind
    from (select subject as entity from prov union select object from prov)"""
)
def entity_parts(spark, sf_dir):
    e = prov_events(spark, sf_dir).select(F.explode(F.array("subject", "object")).alias("entity")).distinct()
    return e.select("entity", fn.entity_prefix(F.col("entity")).alias("prefix"), fn.entity_payload(F.col("entity")).alias("payload"), fn.entity_type(F.col("entity")).alias("kind"))


@query(
    f"""{WITH_PROV}, e as (select entity, split_part(entity, ':', 1) as p, substr(entity, position(':' in entity) + 1) as v from (select subject as entity from prov union select object from prov))
    select entity, case p when 'file' then 'ext=(none);dir_level=1;topdir=' || split_part(v, '/', 2)
      when 'ip' then 'subnet=' || split_part(v, '.', 1) || '.' || split_part(v, '.', 2) || '.' || split_part(v, '.', 3) || '.0/24'
      when 'reg' then 'hive=' || split_part(v, '/', 1) || ';key=' || lower(split_part(v, '/', 2)) || chr(92) || lower(split_part(v, '/', 3))
      else 'name=' || v end as shape from e"""
)
def entity_shapes(spark, sf_dir):
    e = prov_events(spark, sf_dir).select(F.explode(F.array("subject", "object")).alias("entity")).distinct()
    return e.select("entity", fn.entity_shape(F.col("entity")).alias("shape"))


@query(
    """with u as (select page_id, replace(regexp_replace(trim(coalesce(url, '')), '^["'']+|["'']+$', '', 'g'), chr(92), '/') as t from pages)
    select page_id, lower(coalesce(list_last(list_filter(string_split(t, '/'), lambda x: x <> '')), t)) as base from u"""
)
def basename_pages(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", fn.basename(F.col("url")).alias("base"))


@query("select page_id, replace(replace(replace(url, '/', '-'), '–', '-'), '—', '-') as dashed from pages")
def windash_pages(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", fn.windash(F.col("url")).alias("dashed"))


@query(
    """select event_id, case when event_id % 4 = 0 then null else cast(floor(greatest(value, 0)) as bigint) end as n from
    (select event_id, value - case when event_id % 4 = 1 then 5 else 0 end as v0, value from events) t where event_id % 4 <> 1
    union all select event_id, case when value - 5 > -1 then cast(floor(greatest(value - 5, 0)) as bigint) end from events where event_id % 4 = 1"""
)
def normalize_bytes(spark, sf_dir):
    raw = spark.read.parquet(f"{sf_dir}/events.parquet")
    text = F.when(F.col("event_id") % 4 == 0, "no number").when(F.col("event_id") % 4 == 1, (F.col("value") - 5).cast("string")).otherwise(F.concat(F.lit(" "), F.col("value").cast("string")))
    return raw.select("event_id", fn.to_nonneg_int(text).alias("n"))


@query("select event_id, date_trunc('second', ts) as at from events")
def normalize_ts(spark, sf_dir):
    raw = spark.read.parquet(f"{sf_dir}/events.parquet")
    s = F.unix_seconds(F.date_trunc("second", "ts"))
    kind = F.col("event_id") % 5
    text = (
        F.when(kind == 0, s.cast("string"))
        .when(kind == 1, F.concat(s.cast("string"), F.lit("000")))
        .when(kind == 2, F.concat(s.cast("string"), F.lit("000000")))
        .when(kind == 3, F.concat(s.cast("string"), F.lit("000000000")))
        .otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    )
    return raw.select("event_id", fn.parse_ts(text).alias("at"))


@query("select event_type, case event_type when 'click' then 'connect' when 'signup' then 'spawn' else event_type end as relation, cast(count(*) as bigint) as n from events group by all")
def relation_canonical(spark, sf_dir):
    raw = spark.read.parquet(f"{sf_dir}/events.parquet")
    said = F.when(F.col("event_type") == "click", " Connects_To ").when(F.col("event_type") == "signup", "SPAWNED_BY").otherwise(F.col("event_type"))
    return raw.groupBy("event_type", fn.canonical_relation(said).alias("relation")).agg(F.count("*").alias("n"))


@query(
    """select event_id, case when value < 20 then 2.0 when value < 40 then 6.0 when value < 60 then 8.0 else 10.0 end as points,
    round(1.0 / (1 + event_id % 7), 6) as attenuation, (event_id % 5 > 0 and event_id % 5 <= 3) as passes from events"""
)
def severity_scalars(spark, sf_dir):
    raw = spark.read.parquet(f"{sf_dir}/events.parquet")
    v = F.col("value")
    label = F.when(v < 20, "Low").when(v < 40, "5.5").when(v < 60, "HIGH").otherwise("9.9")
    return raw.select("event_id", fn.stage_severity(label).alias("points"), F.round(fn.attenuation(F.col("event_id") % 7), 6).alias("attenuation"), fn.path_factor_passes(F.col("event_id") % 5, F.lit(3)).alias("passes"))


@query("select doc_id from documents where not (contains(lower(text), 'the') and not contains(lower(text), 'license') and not contains(lower(text), 'trash')) or text is null")
def raw_prefilter_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return logs.prefilter(docs, ["the"], ["license", "trash"], "text").select("doc_id")


# ---- rules


@query(f"{WITH_MATCH} select 'm' || seq || '-' || rule_id as match_id, rule_id, seq, host, subject, object, cast(stage as int) as stage, severity from matched")
def rule_event_join(spark, sf_dir):
    return _matches(spark, sf_dir).select("match_id", "rule_id", "seq", "host", "subject", "object", "stage", "severity")


@query(f"{WITH_MATCH} select rule_id, cast(count(*) as bigint) as n, cast(count(distinct subject) as bigint) as subjects from matched group by 1")
def match_counts(spark, sf_dir):
    return _matches(spark, sf_dir).groupBy("rule_id").agg(F.count("*").alias("n"), F.count_distinct("subject").alias("subjects"))


@query(f"{WITH_PROV} select host, subject, sum(bytes)::bigint as bytes, count(*)::bigint as n from prov where op = 'write' and starts_with(object, 'file:/tmp/') group by all")
def tmp_writers(spark, sf_dir):
    found = matches(prov_events(spark, sf_dir), DEMO_RULES[:1])
    return found.groupBy("host", "subject").agg(F.sum("bytes").alias("bytes"), F.count("*").alias("n"))


# ---- noise


@query(f"{WITH_PROV} select subject, op, object, cast(count(*) as bigint) as n from prov group by all having count(*) >= 2")
def benign_profile_train(spark, sf_dir):
    return noise.profile(prov_events(spark, sf_dir), 2)


@query(f"{WITH_MATCH} select seq, rule_id from matched m where not exists (select 1 from (select subject, op, object from prov group by all having count(*) >= 2) p where p.subject = m.subject and p.op = m.op and p.object = m.object)")
def benign_profile_filter(spark, sf_dir):
    return noise.drop_profiled(_matches(spark, sf_dir), noise.profile(prov_events(spark, sf_dir), 2)).select("seq", "rule_id")


SHAPE_CASE = """case split_part({0}, ':', 1) when 'file' then 'ext=(none);dir_level=1;topdir=' || split_part({0}, '/', 2)
  when 'ip' then 'subnet=10.0.' || split_part({0}, '.', 3) || '.0/24' when 'reg' then 'hive=HKLM;key=run' || chr(92) || split_part({0}, '/', 3) else 'name=' || substr({0}, 6) end"""
SIGNED_SQL = f"""{WITH_MATCH}, shaped as (select *, {SHAPE_CASE.format("subject")} as a, {SHAPE_CASE.format("object")} as b, split_part(object, ':', 1) as kind from matched)
  , signed as (select *, rule_id || '|' || stage || '|' || op || '|object/' || case kind when 'proc' then 'process' when 'reg' then 'registry' else kind end || '/' || b || '+subject/process/' || a as signature from shaped)
  , model as (select rule_id, signature, cast(count(*) as bigint) as n, cast(sum(count(*)) over (partition by rule_id) as bigint) as total from signed group by rule_id, signature)
  , vol as (select rule_id, cast(count(*) as bigint) as samples, quantile_disc(bytes, 0.5)::double as p50, quantile_disc(bytes, 0.95)::double as p95, quantile_disc(bytes, 0.99)::double as p99, max(bytes)::double as most from matched group by 1 having count(*) >= 20)
"""


@query(f"{SIGNED_SQL} select * from model")
def signature_counts(spark, sf_dir):
    return noise.signatures(_matches(spark, sf_dir))


@query(f"{SIGNED_SQL} select rule_id, samples, p50, p95, p99, most from vol")
def byte_percentiles(spark, sf_dir):
    return noise.volumes(_matches(spark, sf_dir))


@query(f"{SIGNED_SQL} select s.seq, s.rule_id from signed s left join model using (rule_id, signature) left join vol using (rule_id) where (n >= 3 and n >= 0.05 * total) or coalesce(s.bytes <= p95, false)")
def benign_drop(spark, sf_dir):
    m = cut(_matches(spark, sf_dir))  # matched once, read by both models and the filter
    return noise.benign(m, noise.signatures(m), noise.volumes(m), 3, 0.05).select("seq", "rule_id")


@query(f"{WITH_MATCH}, running as (select *, sum(bytes) over (partition by host, rule_id, subject, object order by seq)::bigint as so_far from matched) select rule_id, cast(max(so_far) + greatest(1, ceil(max(so_far) * 0.25)) as bigint) as threshold from running group by 1")
def dynamic_threshold_train(spark, sf_dir):
    return noise.thresholds(_matches(spark, sf_dir))


LIMIT_SQL = f"""{WITH_MATCH}, good as (select * from matched where bytes > 0)
  , learnt as (select rule_id, subject, object, cast(count(*) as bigint) as samples, cast(sum(bytes) as bigint) as largest from good where ts < timestamp '2024-01-16' group by all
      union all select rule_id, null, null, count(*), cast(sum(bytes) as bigint) from good where ts < timestamp '2024-01-16' group by 1)
  , limits as (select *, cast(largest + greatest(1, ceil(largest * 0.25)) as bigint) as threshold from learnt)"""


#: Limits are learnt from what is before this time, and hold for all.
LEARNT = "ts < timestamp '2024-01-16'"


@query(f"{LIMIT_SQL} select rule_id, subject, object, samples, largest, threshold from limits")
def dynamic_limits(spark, sf_dir):
    return noise.dynamic_thresholds(_matches(spark, sf_dir).where(LEARNT))


@query(
    f"""{LIMIT_SQL}, j as (select m.*, p.threshold as pl, r.threshold as rl from matched m left join limits p on p.rule_id = m.rule_id and p.subject = m.subject and p.object = m.object
      left join limits r on r.rule_id = m.rule_id and r.subject is null)
    , s as (select *, case when pl is not null then sum(case when bytes > 0 then bytes end) over (partition by rule_id, subject, object order by seq) else sum(case when bytes > 0 and pl is null then bytes end) over (partition by rule_id, pl is null order by seq, match_key) end as so_far
      from (select *, rule_id || seq as match_key from j))
    select seq, rule_id, cast(coalesce(bytes > 0 and so_far <= coalesce(pl, rl), false) as boolean) as dropped from s"""
)
def dynamic_threshold_filter(spark, sf_dir):
    m = cut(_matches(spark, sf_dir))
    return noise.dynamic_filter(m, noise.dynamic_thresholds(m.where(LEARNT))).select("seq", "rule_id", "dropped")


# ---- versioned graph


@query(f"{WITH_PROV} {VERSION_SQL} select host, entity, 1 as version, min(seq) as created_seq from stepped group by host, entity union all select host, entity, after, seq from stepped where bump = 1")
def version_nodes(spark, sf_dir):
    return graph.nodes(prov_events(spark, sf_dir))


EDGE_SQL = f"""{VERSION_SQL}, edge as (
  select m.host, m.seq, 'DATA_FLOW' as kind, m.src, s.before as src_version, m.dst, d.after as dst_version from moved m
    join stepped s on s.host = m.host and s.seq = m.seq and s.entity = m.src join stepped d on d.host = m.host and d.seq = m.seq and d.entity = m.dst
  union all select host, seq, 'VERSION_TRANSITION', entity, before, entity, after from stepped where bump = 1)"""


@query(f"{WITH_PROV} {EDGE_SQL} select * from edge")
def version_edges(spark, sf_dir):
    return graph.edges(prov_events(spark, sf_dir))


@query(
    f"""{WITH_PROV} {EDGE_SQL}, made as (select host, entity, 1 as version, min(seq) as at from stepped group by host, entity union all select host, entity, after, seq from stepped where bump = 1)
    select cast(count(*) as bigint) as edges, cast(sum((a.at > b.at or (e.src = e.dst and e.src_version >= e.dst_version))::int) as bigint) as backward from edge e
    join made a on a.host = e.host and a.entity = e.src and a.version = e.src_version join made b on b.host = e.host and b.entity = e.dst and b.version = e.dst_version"""
)
def dag_check(spark, sf_dir):
    return graph.violations(prov_events(spark, sf_dir))


@query(f"{WITH_PROV} {VERSION_SQL} select host, entity, cast(max(after) as int) as version from stepped group by all")
def current_versions(spark, sf_dir):
    return graph.current(prov_events(spark, sf_dir))


@query(
    """with m as (select event_id as seq, 'h' || (user_id % 50) as host, 'mem:' || user_id as area, event_type = 'click' as executable from events)
    , f as (select *, first_value(executable) over (partition by host, area order by seq) as first_exec from m)
    select host, area, seq, cast(sum(executable::int) over (partition by host, area order by seq) + (not first_exec)::int as int) as version from f"""
)
def vma_versions(spark, sf_dir):
    raw = spark.read.parquet(f"{sf_dir}/events.parquet")
    m = raw.select(F.col("event_id").alias("seq"), F.concat(F.lit("h"), F.col("user_id") % 50).alias("host"), F.concat(F.lit("mem:"), "user_id").alias("area"), (F.col("event_type") == "click").alias("executable"))
    return graph.vma_versions(m).withColumn("version", (F.col("version")).cast("int")).select("host", "area", "seq", "version")


LINE_SQL = ", line as (select distinct host, subject as parent, object as child from prov where op = 'fork' and subject <> object)"


@query(f"{WITH_PROV} {LINE_SQL} select * from line")
def process_lineage(spark, sf_dir):
    return graph.lineage(prov_events(spark, sf_dir))


@query(f"{WITH_PROV} {LINE_SQL}, anc as (select host, child as process, parent as ancestor from line union select a.host, a.process, l.parent from anc a join line l on l.host = a.host and l.child = a.ancestor) select * from anc")
def process_ancestors(spark, sf_dir):
    return graph.ancestors(prov_events(spark, sf_dir))


REACH_SQL = f"""{EDGE_SQL}, last as (select host, entity, max(after) as version from stepped group by all)
  , up as (select host, entity as dst, entity, version from last union select u.host, u.dst, e.src, e.src_version from up u join edge e on e.host = u.host and e.dst = u.entity and e.dst_version = u.version)"""


@query(f"{WITH_PROV} {REACH_SQL} select host, dst, entity as src, cast(max(version) as int) as src_version from up where dst <> entity group by all")
def entity_reach(spark, sf_dir):
    return graph.entity_reach(prov_events(spark, sf_dir))


@query(f"{WITH_PROV}, seen as (select host, entity, max(ts) as last_seen from (select host, ts, subject as entity from prov union all select host, ts, object from prov) group by all) select host, entity, last_seen from seen where last_seen > (select max(ts) from prov) - interval 432000 seconds")
def retention_prune(spark, sf_dir):
    return graph.prune_stale(prov_events(spark, sf_dir), 5)


@query(f"{WITH_PROV}, seen as (select host, entity, max(seq) as last_seq from (select host, seq, subject as entity from prov union all select host, seq, object from prov) group by all) select host, entity, last_seq from seen qualify row_number() over (partition by host order by last_seq desc, entity) <= 20")
def cap_prune(spark, sf_dir):
    return graph.prune_to(prov_events(spark, sf_dir), 20)


# ---- state


@query(
    f"""{WITH_MATCH}, passed as (select host, seq, case when op = 'read' then object else subject end as src, case when op = 'read' then subject else object end as dst from prov)
    , tainted as (select host, subject as entity, seq from matched where rule_id = 'tmp_write' union select host, object, seq from matched where rule_id = 'tmp_write'
      union select p.host, p.dst, p.seq from tainted t join passed p on p.host = t.host and p.src = t.entity and p.seq > t.seq)
    select host, entity, min(seq) as tainted_seq from tainted group by all"""
)
def taint_spread(spark, sf_dir):
    events = prov_events(spark, sf_dir)
    return state.taint(events, state.seeds(matches(events, DEMO_RULES), DEMO_RULES[:1]))


@query(f"{WITH_PROV} select seq, cast(max(case when bytes < 2000 then 1 when bytes < 5000 then 2 when bytes < 9000 then 3 else 4 end) over (partition by host, subject order by seq) as int) as privilege from prov")
def privilege_running_max(spark, sf_dir):
    b = F.col("bytes")
    return state.privilege(prov_events(spark, sf_dir), F.when(b < 2000, 1).when(b < 5000, 2).when(b < 9000, 3).otherwise(4)).select("seq", "privilege")


NEEDS = {"odd_subnet": "tmp_write", "run_key": "odd_subnet"}


@query(
    f"""{WITH_MATCH} select m.seq, m.rule_id, cast((select max(e.seq) from matched e where e.host = m.host and e.subject = m.subject and e.seq < m.seq
      and e.rule_id = case m.rule_id when 'odd_subnet' then 'tmp_write' when 'run_key' then 'odd_subnet' end) as bigint) as after_seq from matched m"""
)
def technique_chain(spark, sf_dir):
    return state.technique_chain(_matches(spark, sf_dir), NEEDS).select("seq", "rule_id", "after_seq")


@query(f"{WITH_MATCH}, newest as (select host, max(ts) as now from matched group by 1) select seq, rule_id from matched join newest using (host) where cast(floor(epoch(now)) as bigint) - cast(floor(epoch(ts)) as bigint) > 864000")
def pending_ttl(spark, sf_dir):
    return state.pending_expired(_matches(spark, sf_dir), 864_000).select("seq", "rule_id")


# ---- scenarios

LINK_SQL = f"""{WITH_MATCH}, n as (select *, seq * 8192 + rule_order as node from matched)
  , held as (select host, node, rule_id, asks, 'subject' as role, subject as entity from n union all select host, node, rule_id, asks, 'object', object from n)
  , hub as (select host, role, entity, min(node) as hub from held where asks group by all)
  , star as (select distinct least(hub, node) as a, greatest(hub, node) as b from held join hub using (host, role, entity) where hub <> node)
  , way as (select a as x, b as y from star union all select b, a from star)
  , meet as (select node as x, node as y from n union select m.x, w.y from meet m join way w on w.x = m.y)
  , scenario as (select x as node, min(y) as scenario from meet group by 1)"""


@query(
    f"""{LINK_SQL}, by_rule as (select host, role, entity, rule_id, asks, count(*) as n from held group by all)
    select a.host, a.role, a.entity, a.rule_id as rule_a, b.rule_id as rule_b, cast(case when a.rule_id = b.rule_id then a.n * (a.n - 1) // 2 else a.n * b.n end as bigint) as links
    from by_rule a join by_rule b on a.host = b.host and a.role = b.role and a.entity = b.entity and a.rule_id <= b.rule_id and (a.asks or b.asks) where not (a.rule_id = b.rule_id and a.n = 1)"""
)
def shared_entity_edges(spark, sf_dir):
    return links.shared_entity_edges(_matches(spark, sf_dir), DEMO_RULES)


def _scenarios(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = cut(_matches(spark, sf_dir))
    return hsg.scenarios(found, links.star_links(found, DEMO_RULES))


@query(f"{LINK_SQL} select 'm' || seq || '-' || rule_id as match_id, cast(scenario as bigint) as scenario from n join scenario using (node)")
def hsg_components(spark, sf_dir):
    return _scenarios(spark, sf_dir).select("match_id", "scenario")


LEGACY_SQL = f"""{LINK_SQL}, m as (select * from n join scenario using (node))
  , pair as (select a.scenario, count(*) as edges from m a join m b on a.host = b.host and a.node < b.node and (a.asks or b.asks) and (a.subject = b.subject or a.object = b.object) group by 1)
  , score as (select cast(scenario as bigint) as scenario, cast(count(*) as bigint) as nodes, cast(coalesce(max(edges), 0) as bigint) as edges, sum(severity) as severity_sum from m left join pair using (scenario) group by 1)"""


@query(f"{LEGACY_SQL} select scenario, nodes, edges, nodes + 0.5 * edges as structure, severity_sum, severity_sum as weighted, 1.0::double as connectivity, 1.0::double as multiplier from score")
def scenario_legacy(spark, sf_dir):
    return hsg.legacy_scores(_scenarios(spark, sf_dir), DEMO_RULES)


@query(
    f"""{LEGACY_SQL}, two as (select cast(scenario as varchar) as scenario, severity_sum as score, nodes, edges from score order by score desc, nodes desc, edges desc, 1 limit 60)
    , filled as (select *, 0 as f from two union all select null, 0.0, 0, 0, 1 from range(60))
    select cast(row_number() over (order by f, score desc, nodes desc, edges desc, scenario) as int) as place, scenario, score, nodes, edges from filled qualify place <= 60"""
)
def top_scenarios_filled(spark, sf_dir):
    scores = hsg.legacy_scores(_scenarios(spark, sf_dir), DEMO_RULES).withColumn("scenario", F.col("scenario").cast("string"))
    return hsg.top(scores, "weighted", 60)


# what follows scores hosts as scenarios, so that SQL needs no graph search


def _by_host(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _matches(spark, sf_dir).withColumn("scenario", F.col("host"))


STAGE_SQL = f"{WITH_MATCH}, t as (select host as scenario, " + ", ".join(f"max(case when stage = {i} then cvss end) as s{i}" for i in range(1, 8)) + " from matched group by 1)"
POINTS_SQL = "case when {0} is null then 1.0 when {0} < 4 then 2.0 when {0} < 7 then 6.0 when {0} < 9 then 8.0 else 10.0 end"


@query(f"{STAGE_SQL} select * from t")
def threat_tuple(spark, sf_dir):
    return hsg.threat_tuple(_by_host(spark, sf_dir))


@query(f"{STAGE_SQL} select scenario, round(exp(" + " + ".join(f"ln(1 + greatest(0, least(10, coalesce(s{i}, 0))) / 10)" for i in range(1, 8)) + "), 6) as paper_score from t")
def scenario_paper(spark, sf_dir):
    return hsg.paper_scores(_by_host(spark, sf_dir))


@query(f"{STAGE_SQL} select scenario, round(exp(" + " + ".join(f"ln({POINTS_SQL.format(f's{i}')})" for i in range(1, 8)) + "), 6) as exact_score from t")
def scenario_exact(spark, sf_dir):
    return hsg.exact_scores(_by_host(spark, sf_dir))


@query(
    f"{WITH_MATCH}, r as (select host, seq, seq * 8192 + rule_order as node, round(exp("
    + " + ".join(f"ln({POINTS_SQL.format(f'max(case when stage = {i} then cvss end) over w')})" for i in range(1, 8))
    + "), 6) as score from matched window w as (partition by host order by seq * 8192 + rule_order)) select host as scenario, min(seq) as detect_seq, arg_min(score, node) as score from r where score >= 480 group by 1"
)
def exact_first_detection(spark, sf_dir):
    return hsg.first_detection(_by_host(spark, sf_dir), 480.0)


@query(f"{WITH_MATCH} select host as scenario, sum(severity) as total, cast(count(*) as bigint) as n from matched group by 1 order by total desc, n desc, scenario limit 3")
def top_k_scenarios(spark, sf_dir):
    got = _by_host(spark, sf_dir).groupBy("scenario").agg(F.sum("severity").alias("total"), F.count("*").alias("n"))
    return got.orderBy(F.desc("total"), F.desc("n"), "scenario").limit(3)


ALERT_SQL = f"""{WITH_MATCH}, n as (select *, seq * 8192 + rule_order as node from matched)
  , a as (select host as scenario, seq, cast(node as bigint) as node, sum(severity) over w as total, cast(len(list_distinct(list(stage) over w)) as bigint) as stages, row_number() over w as i from n window w as (partition by host order by node))
  , walk as (select scenario, 0 as i, cast(null as double) as last, cast(0 as bigint) as told, false as fired from a group by 1
      union all select w.scenario, w.i + 1, case when f then a.total else w.last end, case when f then a.stages else w.told end, f from walk w join a on a.scenario = w.scenario and a.i = w.i + 1
        cross join lateral (select a.total >= 80 and (w.last is null or a.total - w.last >= 10 or a.stages > w.told) as f))
  , raised as (select a.scenario, a.seq, a.node, a.total, a.stages from walk w join a on a.scenario = w.scenario and a.i = w.i where w.fired)"""


@query(f"{ALERT_SQL} select * from raised")
def alert_suppression(spark, sf_dir):
    return hsg.alerts(_by_host(spark, sf_dir))


@query(f"{ALERT_SQL} select * from raised qualify row_number() over (partition by scenario order by total desc, stages desc, node) = 1")
def alert_dedupe(spark, sf_dir):
    return hsg.best_alerts(hsg.alerts(_by_host(spark, sf_dir)))


@query(f"{WITH_MATCH}, l as (select host as scenario, max(ts) as last_seen from matched group by 1) select * from l where cast(floor(epoch((select max(ts) from matched))) as bigint) - cast(floor(epoch(last_seen)) as bigint) > 3600")
def dormant_scenarios(spark, sf_dir):
    return hsg.dormant(_by_host(spark, sf_dir), 3600)


@query(
    f"""{WITH_MATCH}, c as (select host, bool_or(severity >= 10) as said, sum(bytes) > 100000 as truth from matched group by 1)
    , n as (select count(*) filter (said and truth) as tp, count(*) filter (said and not truth) as fp, count(*) filter (not said and not truth) as tn, count(*) filter (not said and truth) as fn from c)
    , q as (select *, tp / nullif(tp + fp, 0)::double as p, tp / nullif(tp + fn, 0)::double as r from n)
    select tp, fp, tn, fn, round(coalesce(p, 0), 6) as precision, round(coalesce(r, 0), 6) as recall, round(coalesce(2 * p * r / nullif(p + r, 0), 0), 6) as f1 from q"""
)
def campaign_metrics(spark, sf_dir):
    c = _matches(spark, sf_dir).groupBy("host").agg(F.bool_or(F.col("severity") >= 10).alias("said"), (F.sum("bytes") > 100_000).alias("truth"))
    return windows.campaign_metrics(c, "said", "truth")


# ---- windows


@query(f"{WITH_PROV} select host, op, time_bucket(interval '6 hours', ts) as start, cast(count(*) as bigint) as n from prov group by all having count(*) >= 2")
def sigma_count_by_window(spark, sf_dir):
    return windows.count_by_window(prov_events(spark, sf_dir), ["host", "op"], "6 hours", 2)


@query(f"{WITH_PROV} select host, time_bucket(interval '1 day', ts) as start, cast(count(distinct object) as bigint) as n from prov group by all having count(distinct object) >= 3")
def sigma_distinct_by_window(spark, sf_dir):
    return windows.distinct_by_window(prov_events(spark, sf_dir), ["host"], "object", "1 day", 3)


@query(f"{WITH_PROV}, w as (select *, max(case when op = 'write' then ts end) over (partition by host order by seq rows between unbounded preceding and 1 preceding) as near_ts from prov) select seq, host, near_ts from w where op = 'connect' and epoch_us(ts) - epoch_us(near_ts) <= 21600000000")
def sigma_near(spark, sf_dir):
    return windows.near(prov_events(spark, sf_dir), ["host"], F.col("op") == "write", F.col("op") == "connect", 21_600).select("seq", "host", "near_ts")


@query(f"{WITH_PROV} select start, cast(count(*) as bigint) as n from (select unnest([time_bucket(interval '12 hours', ts), time_bucket(interval '12 hours', ts) - interval '12 hours']) as start from prov) group by 1")
def rolling_rates(spark, sf_dir):
    return windows.rates(prov_events(spark, sf_dir))


# ---- paths


#: Path factors of the pairs (host, x, y) of a table ``pair``, over REACH_SQL.
FACTOR_SQL = """
  , newest as (select host, dst, entity, max(version) as v from up group by all)
  , shared as (select p.host, p.x, p.y, a.entity, least(a.v, b.v) as v from pair p join newest a on a.host = p.host and a.dst = p.x join newest b on b.host = p.host and b.dst = p.y and b.entity = a.entity)
  , above as (select distinct host, entity as f, v as fv, entity, v as version from shared union select u.host, u.f, u.fv, e.src, e.src_version from above u join edge e on e.host = u.host and e.dst = u.entity and e.dst_version = u.version)
  , high as (select host, f, fv, entity, max(version) as v from above group by all)
  , lower as (select distinct c.host, c.x, c.y, c.entity from shared c join shared d on d.host = c.host and d.x = c.x and d.y = c.y and d.entity <> c.entity
      join high h on h.host = d.host and h.f = d.entity and h.fv = d.v and h.entity = c.entity and h.v >= c.v)
  , tally as (select host, x, y, count(*) as n from (select host, x, y, entity from shared except select host, x, y, entity from lower) group by all)
  , factor as (select p.host, p.x, p.y, cast(case when r.v is not null then n end as bigint) as path_factor, coalesce(case when r.v is not null then 1.0 / n end, 0.0)::double as strength
      from pair p left join tally t on t.host = p.host and t.x = p.x and t.y = p.y left join newest r on r.host = p.host and r.dst = p.y and r.entity = p.x)"""


@query(f"{WITH_PROV} {REACH_SQL}, pair as (select distinct host, subject as x, object as y from prov where op = 'write') {FACTOR_SQL} select * from factor")
def path_factor(spark, sf_dir):
    events = prov_events(spark, sf_dir)
    written = events.where("op = 'write'").select("host", F.col("subject").alias("x"), F.col("object").alias("y")).distinct()
    return paths.path_factors(events, written)


@query(
    f"""{WITH_PROV} {EDGE_SQL}, node as (select host, entity, before as version from stepped union select host, entity, after from stepped)
    , walk as (select n.host, n.entity as source, n.entity, n.version, 0 as hops from node n where exists (select 1 from prov p where p.host = n.host and p.object = n.entity and p.op = 'connect')
        union select w.host, w.source, e.dst, e.dst_version, w.hops + (e.kind = 'DATA_FLOW' and e.src <> e.dst)::int from walk w join edge e on e.host = w.host and e.src = w.entity and e.src_version = w.version where w.hops < 64)
    select host, source, entity, cast(min(hops) as int) as hops from walk group by all"""
)
def shortest_hops(spark, sf_dir):
    events = prov_events(spark, sf_dir)
    return paths.distances(events, events.where("op = 'connect'").select("host", F.col("object").alias("entity")).distinct())


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writers to temporary folders, by the bytes they wrote."""
    return tmp_writers(spark, sf_dir).orderBy(F.desc("bytes"), "host", "subject").limit(3)
