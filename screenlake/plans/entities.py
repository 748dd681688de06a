"""Queries over versions, entity-years, crosswalks, and rate breakdowns."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import expr
from ..functions.expr import as_count, percent, rounded
from ..operators import breakdowns as b, codes, entities as ops
from ..operators.ranks import quantiles
from . import standins as s
from .registry import query

V = f"WITH {s.VERSIONS}"
W = s.wilson_sql()
E = f"WITH {s.ENTITIES}"
EY = f"WITH {s.entity_year_sql('fy', 'F')}, {s.entity_year_sql('oy', 'O')}"
LATEST = "latest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY event ORDER BY created DESC, version DESC) AS rn FROM versions) WHERE rn = 1)"


@query(f"{V}, {LATEST} SELECT event, version, created, amount, status, priority FROM latest")
def latest_version(spark, d):
    return ops.latest_version(s.versions(spark, d))


@query(f"{V}, {LATEST}, best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY event ORDER BY created DESC, version DESC) AS rn FROM versions WHERE priority = '1-URGENT') WHERE rn = 1) SELECT l.event, coalesce(p.version, l.version) AS version, coalesce(p.created, l.created) AS created, coalesce(p.amount, l.amount) AS amount, coalesce(p.status, l.status) AS status, coalesce(p.priority, l.priority) AS priority FROM latest l LEFT JOIN best p USING (event)")
def dedup_with_preferred(spark, d):
    return ops.dedup_with_preferred(s.versions(spark, d), F.col("priority") == "1-URGENT")


@query(f"{V} SELECT event, year(created)::BIGINT AS year, version, priority FROM versions QUALIFY row_number() OVER (PARTITION BY event, year(created) ORDER BY CASE priority WHEN '1-URGENT' THEN 0 WHEN '2-HIGH' THEN 1 ELSE 2 END, created DESC, version DESC) = 1")
def dedup_by_priority(spark, d):
    from ..operators.runs import first_by

    rank = F.when(F.col("priority") == "1-URGENT", 0).when(F.col("priority") == "2-HIGH", 1).otherwise(2)
    v = s.versions(spark, d).withColumn("year", F.year("created").cast("bigint"))
    return first_by(v, ["event", "year"], rank, F.desc("created"), F.desc("version")).select("event", "year", "version", "priority")


BOTH = "both_years AS (SELECT *, 'first' AS source, NULL::DOUBLE AS extra FROM fy UNION ALL SELECT *, 'second', amount / 2 FROM oy)"


def both_years(spark, d):
    second = s.entity_year(spark, d, "O").withColumn("extra", F.col("amount") / 2)
    return ops.stacked(s.entity_year(spark, d, "F"), second, ("first", "second"))


@query(f"{EY}, {BOTH} SELECT entity, year, amount, n, source, round(extra, 6) AS extra FROM both_years")
def stack_sources(spark, d):
    return both_years(spark, d).withColumn("extra", rounded("extra")).select("entity", "year", "amount", "n", "source", "extra")


@query(f"{EY}, {BOTH} SELECT entity, year, amount, source FROM both_years QUALIFY row_number() OVER (PARTITION BY entity, year ORDER BY source) = 1")
def prefer_source(spark, d):
    from ..operators.runs import first_by

    return first_by(both_years(spark, d), ["entity", "year"], F.asc("source")).select("entity", "year", "amount", "source")


@query(f"WITH {s.CROSSWALK} SELECT entity, code, obs FROM crosswalk QUALIFY row_number() OVER (PARTITION BY entity ORDER BY obs DESC, code) = 1")
def refine_crosswalk(spark, d):
    return ops.refine_crosswalk(s.crosswalk(spark, d))


@query(f"WITH {s.CROSSWALK} SELECT code, count(*) AS n_rows, count(DISTINCT entity) AS n_partners FROM crosswalk GROUP BY 1 HAVING count(*) > 1")
def key_uniqueness(spark, d):
    return ops.key_uniqueness(s.crosswalk(spark, d), "code", "entity", unique=True)


@query(f"WITH {s.CROSSWALK} SELECT entity, code, obs, p_brand AS brand FROM crosswalk JOIN part ON code = p_partkey WHERE obs >= 2")
def crosswalk_join(spark, d):
    p = s.table(spark, d, "part").select(F.col("p_partkey").alias("code"), F.col("p_brand").alias("brand"))
    return s.crosswalk(spark, d).where("obs >= 2").join(p, "code").select("entity", "code", "obs", "brand")


@query(f"{EY}, {BOTH}, one AS (SELECT * FROM both_years QUALIFY row_number() OVER (PARTITION BY entity, year ORDER BY source) = 1), cw AS (SELECT l_suppkey AS entity, l_partkey AS code, count(*) AS obs FROM lineitem GROUP BY 1, 2), best AS (SELECT * FROM cw QUALIFY row_number() OVER (PARTITION BY entity ORDER BY obs DESC, code) = 1) SELECT entity, year, amount, source, code FROM one JOIN best USING (entity)")
def entity_year_dataset(spark, d):
    return prefer_source(spark, d).join(refine_crosswalk(spark, d).select("entity", "code"), "entity").select("entity", "year", "amount", "source", "code")


@query(f"{V}, {s.entity_year_sql('fy', 'F')} SELECT version, event, year(created)::BIGINT AS year, fy.amount AS year_amount FROM versions LEFT JOIN fy ON event = entity AND year(created) = fy.year")
def entity_year_enrich(spark, d):
    v = s.versions(spark, d).select("version", F.col("event").alias("entity"), F.year("created").cast("bigint").alias("year"))
    return ops.enriched(v, s.entity_year(spark, d, "F").select("entity", "year", F.col("amount").alias("year_amount")), ["entity", "year"]).select("version", F.col("entity").alias("event"), "year", "year_amount")


@query(f"{E} SELECT entity, CASE WHEN covariate >= 0 AND covariate <= 9000 THEN covariate END AS covariate, CASE WHEN sector >= 1 THEN sector END AS sector FROM entities")
def clean_ranges(spark, d):
    return ops.clean_ranges(s.entities(spark, d).select("entity", "covariate", "sector"), {"covariate": (0, 9000), "sector": (1, None)})


@query("SELECT 'c_name' AS column_name, count(DISTINCT c_name) AS n_values, count(DISTINCT c_name) <= 1 AS is_constant FROM customer UNION ALL SELECT 'currency', 1, true")
def drop_constant_cols(spark, d):
    return ops.constant_columns(s.table(spark, d, "customer").select("c_name", F.lit("USD").alias("currency")))


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderstatus IN ('F', 'O') AND o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_orderdate >= TIMESTAMP '1997-01-01'")
def prefilter_bundle(spark, d):
    o = s.table(spark, d, "orders")
    keep = F.col("o_orderstatus").isin("F", "O") & F.col("o_orderpriority").isin("1-URGENT", "2-HIGH") & (F.col("o_orderdate") >= F.lit("1997-01-01").cast("timestamp"))
    return o.where(keep).select("o_orderkey", "o_custkey", "o_totalprice")


@query("SELECT o_orderkey FROM orders WHERE o_custkey IN (1, 5, 7, 100)")
def docs_of_entities(spark, d):
    return s.table(spark, d, "orders").where(F.col("o_custkey").isin(1, 5, 7, 100)).select("o_orderkey").distinct()


@query("SELECT DISTINCT o_custkey AS entity, o_orderstatus AS status FROM orders")
def distinct_entity_docs(spark, d):
    return s.table(spark, d, "orders").select(F.col("o_custkey").alias("entity"), F.col("o_orderstatus").alias("status")).dropDuplicates()


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')")
def missing_ids(spark, d):
    o = s.table(spark, d, "orders").where("o_orderstatus = 'F'")
    return s.table(spark, d, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query(f"{V}, h AS (SELECT version, event, quarter(created)::BIGINT AS quarter, year(created)::BIGINT AS year FROM versions), r AS (SELECT event, quarter, year, count(*) AS n_ratings FROM h WHERE version % 4 = 0 GROUP BY 1, 2, 3) SELECT version, event, quarter, year, n_ratings FROM h JOIN r USING (event, quarter, year)")
def link_by_period(spark, d):
    from ..functions.parsing import period

    head = F.concat(F.lit("Customer, Q"), F.quarter("created").cast("string"), F.lit(" "), F.year("created").cast("string"), F.lit(" Call"))
    q, y = period(head)
    h = s.versions(spark, d).select("version", "event", q.alias("quarter"), y.alias("year"))
    r = h.where("version % 4 = 0").groupBy("event", "quarter", "year").agg(as_count(F.count(F.lit(1))).alias("n_ratings"))
    return h.join(r, ["event", "quarter", "year"], "left").dropna(subset=["n_ratings"]).select("version", "event", "quarter", "year", "n_ratings")


@query(f"{E}, g AS (SELECT sector, count(flag) AS n, sum(flag::INT)::BIGINT AS hits FROM entities GROUP BY 1) SELECT sector, n, hits, {W}, r_name AS name FROM g JOIN region ON r_regionkey = sector")
def sector_rates(spark, d):
    names = s.table(spark, d, "region").select(F.col("r_regionkey").cast("bigint").alias("sector"), F.col("r_name").alias("name"))
    return b.rates(s.entities(spark, d), ["sector"]).join(F.broadcast(names), "sector")  # a row a region


@query(f"WITH g AS (SELECT year(o_orderdate)::BIGINT AS year, count(*) AS n, count(*) FILTER (WHERE o_totalprice > 300000) AS hits FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01' GROUP BY 1) SELECT year, n, hits, {W} FROM g")
def year_rates(spark, d):
    o = s.table(spark, d, "orders").where(F.year("o_orderdate") >= 1996)
    return b.rates(o.select(F.year("o_orderdate").cast("bigint").alias("year"), (F.col("o_totalprice") > 300000).alias("flag")), ["year"])


@query(f"{E}, q AS (SELECT list_distinct(quantile_cont(covariate, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9])) AS e FROM entities), x AS (SELECT 1 + len(list_filter(e, lambda v: v < covariate)) AS bin, flag, covariate FROM entities, q), g AS (SELECT bin, count(flag) AS n, sum(flag::INT)::BIGINT AS hits, round(avg(covariate), 6) AS mean_covariate FROM x GROUP BY 1) SELECT bin, n, hits, mean_covariate, {W} FROM g")
def quantile_bin_rates(spark, d):
    return b.rates(b.quantile_bins(s.entities(spark, d), "covariate"), ["bin"], mean_of="covariate")


def coded(spark, d):
    """Entities with a code of eight digits too; every tenth has only four digits of its six, with zeros behind."""
    e = s.entities(spark, d)
    naics = F.when(F.col("entity") % 10 == 0, F.concat("sic", F.lit("00"))).otherwise(F.col("naics"))
    return e.select("entity", "flag", "covariate", "sic", naics.alias("naics"), F.concat("naics", F.lit("0"), (F.col("entity") % 2 + 1).cast("string")).alias("gics"))


CODED = f"{E}, coded AS (SELECT entity, flag, covariate, sic, CASE WHEN entity % 10 = 0 THEN sic || '00' ELSE naics END AS naics, naics || '0' || (entity % 2 + 1) AS gics FROM entities)"
HIER = f"""{CODED}, {s.CODE_NAMES}, lv(system, level, last) AS (VALUES ('gics', 2, 8), ('gics', 4, 8), ('gics', 6, 8), ('gics', 8, 8), ('naics', 2, 6), ('naics', 3, 6), ('naics', 4, 6), ('naics', 5, 6), ('naics', 6, 6), ('sic', 2, 4), ('sic', 3, 4), ('sic', 4, 4)),
x AS (SELECT unnest([{{'s': 'gics', 'c': gics}}, {{'s': 'naics', 'c': naics}}, {{'s': 'sic', 'c': sic}}]) AS z, flag FROM coded),
w AS (SELECT z.s AS system, z.c AS whole, count(flag) AS n, sum(flag::INT) AS hits FROM x GROUP BY 1, 2),
o AS (SELECT w.*, coalesce((SELECT max_by(c.code, length(c.code)) FROM code_names c WHERE starts_with(w.whole, c.code) AND replace(substr(w.whole, length(c.code) + 1), '0', '') = ''), w.whole) AS own FROM w),
g AS (SELECT system, level::BIGINT AS level, last, own[1:level] AS code, sum(n)::BIGINT AS n, sum(hits)::BIGINT AS hits FROM o JOIN lv USING (system) WHERE length(own) >= level GROUP BY 1, 2, 3, 4)
SELECT system, level, g.code, coalesce(name, CASE WHEN level = last THEN (SELECT max_by(c.name, length(c.code)) FROM code_names c WHERE starts_with(g.code, c.code) AND c.code <> g.code) || ' (code: ' || g.code || ')' END, upper(system) || ' ' || g.code) AS name, n, hits, round(100.0 * hits / n, 2) AS pct FROM g LEFT JOIN code_names ON g.code = code_names.code"""


@query(HIER)
def hierarchy_rates(spark, d):
    """Every name is also listed at a less specific level, under another name, which doesn't count."""
    names = s.code_names(spark, d).withColumns({"level": F.length("code"), "system": F.explode(F.array(*map(F.lit, codes.LEVELS)))})
    vague = names.withColumns({"level": F.col("level") - 1, "name": F.concat(F.lit("part of "), "name")})
    return codes.hierarchy_rates(coded(spark, d), {c: c for c in codes.LEVELS}, names.unionByName(vague))


def code_counts(spark, d):
    return s.entities(spark, d).groupBy(F.col("naics").alias("code")).agg(as_count(F.count("flag")).alias("n"), as_count(F.sum(F.col("flag").cast("int"))).alias("hits"))


CODES = f"{E}, codes AS (SELECT naics AS code, count(flag) AS n, sum(flag::INT)::BIGINT AS hits FROM entities GROUP BY 1)"


@query(f"{CODES}, seg(segment, prefix) AS (VALUES ('north', '10'), ('north', '1005'), ('south', '11'), ('mixed', '1206'), ('mixed', '13')), h AS (SELECT DISTINCT segment, code, n, hits FROM codes JOIN seg ON starts_with(code, prefix)), g AS (SELECT segment, sum(n)::BIGINT AS n, sum(hits)::BIGINT AS hits FROM h GROUP BY 1) SELECT segment, n, hits, {W} FROM g")
def segment_rates(spark, d):
    segments = spark.createDataFrame([("north", "10"), ("north", "1005"), ("south", "11"), ("mixed", "1206"), ("mixed", "13")], "segment string, prefix string")
    return b.prefix_rates(code_counts(spark, d), segments)


@query(f"{CODES}, listed(code) AS (VALUES ('100508'), ('110608'), ('120710'), ('999999')) SELECT code, coalesce(n, 0)::BIGINT AS n, coalesce(hits, 0)::BIGINT AS hits, n IS NULL AS missing FROM listed LEFT JOIN codes USING (code)")
def listed_code_rates(spark, d):
    listed = spark.createDataFrame([("100508",), ("110608",), ("120710",), ("999999",)], "code string")
    c = listed.join(code_counts(spark, d), "code", "left")
    zero = F.lit(0).cast("bigint")
    return c.select("code", F.coalesce("n", zero).alias("n"), F.coalesce("hits", zero).alias("hits"), F.col("n").isNull().alias("missing"))


@query(f"{E}, {s.CODE_NAMES}, a AS (SELECT DISTINCT naics AS code FROM entities) SELECT a.code, c.code AS ancestor, c.name FROM a JOIN code_names c ON starts_with(a.code, c.code) QUALIFY row_number() OVER (PARTITION BY a.code ORDER BY length(c.code) DESC) = 1")
def ancestor_lookup(spark, d):
    return b.nearest_ancestor(s.entities(spark, d).select(F.col("naics").alias("code")), s.code_names(spark, d))


SAMPLES = {"chemicals": {"sic": ["10"], "naics": ["10"], "gics": ["99"]}, "cement": {"naics": ["1206"], "gics": ["99"]}, "airlines": {"gics": ["13", "1103"]}}
FLAGS = "sample_flags AS (SELECT *, starts_with(sic, '10') AS chemicals, starts_with(naics, '1206') AS cement, starts_with(gics, '13') OR starts_with(gics, '1103') AS airlines FROM coded)"


def sample_flags(spark, d):
    """Each sample by the first system it is declared in: by SIC, by NAICS, by GICS."""
    return codes.memberships(coded(spark, d), SAMPLES)


@query(f"{CODED}, {FLAGS} SELECT entity, chemicals, cement, airlines FROM sample_flags")
def industry_sample_flags(spark, d):
    return sample_flags(spark, d).select("entity", *SAMPLES)


@query(f"{CODED}, {FLAGS}, m AS (SELECT unnest([{{'i': 'chemicals', 'm': chemicals}}, {{'i': 'cement', 'm': cement}}, {{'i': 'airlines', 'm': airlines}}]) AS z, flag, covariate > 5000 AS rich FROM sample_flags), x AS (SELECT z.i AS industry, unnest([{{'f': 'flag', 'v': flag}}, {{'f': 'rich', 'v': rich}}]) AS y FROM m WHERE z.m), g AS (SELECT industry, y.f AS flag_name, count(y.v) AS n, sum(y.v::INT)::BIGINT AS hits FROM x GROUP BY 1, 2) SELECT industry, flag_name, n, hits, {W} FROM g")
def industry_sample_rates(spark, d):
    rows = sample_flags(spark, d).withColumn("rich", F.col("covariate") > 5000)
    members = F.explode(F.filter(F.array(*[F.when(F.col(c), F.lit(c)) for c in SAMPLES]), lambda x: x.isNotNull()))
    flags = F.explode(F.array(*[F.struct(F.lit(f).alias("flag_name"), F.col(f).alias("value")) for f in ("flag", "rich")]))
    return b.rates(rows.withColumn("industry", members).select("industry", flags.alias("f")).select("industry", "f.flag_name", F.col("f.value").alias("flag")), ["industry", "flag_name"])


@query(f"{E}, t AS (SELECT 'sector' AS kind, sector::VARCHAR AS name, flag FROM entities UNION ALL SELECT 'segment', segment, flag FROM entities), g AS (SELECT kind, name, count(flag) AS n, sum(flag::INT)::BIGINT AS hits FROM t GROUP BY 1, 2) SELECT kind, name, n, hits, {W}, round(100.0 * (sum(hits) OVER (PARTITION BY kind)) / (sum(n) OVER (PARTITION BY kind)), 6) AS overall_pct FROM g")
def sector_segment_table(spark, d):
    kinds = F.explode(F.array(F.struct(F.lit("sector").alias("kind"), F.col("sector").cast("string").alias("name")), F.struct(F.lit("segment").alias("kind"), F.col("segment").alias("name"))))
    r = b.rates(s.entities(spark, d).select("flag", kinds.alias("k")).select("flag", "k.*"), ["kind", "name"])
    whole = r.groupBy("kind").agg(rounded(percent(F.sum("hits"), F.sum("n"))).alias("overall_pct"))
    return r.join(F.broadcast(whole), "kind")  # a row a kind


@query(f"{V}, p AS (SELECT priority, event, count(*) AS n, count(*) FILTER (WHERE amount > 300000) AS hits FROM versions GROUP BY 1, 2) SELECT priority, event, row_number() OVER w AS rank, n, hits, round(100.0 * hits / n, 6) AS pct FROM p WINDOW w AS (PARTITION BY priority ORDER BY n DESC, hits DESC, event) QUALIFY row_number() OVER w <= 10")
def entity_leaderboard(spark, d):
    return b.leaderboard(s.versions(spark, d).withColumn("big", F.col("amount") > 300000), "priority", "event", "big", 10)


HIST = "SELECT {by} b.bin, '[' || printf('%.2f', lo + (b.bin - 1) * (hi - lo) / {k}) || ', ' || printf('%.2f', lo + b.bin * (hi - lo) / {k}) || CASE WHEN b.bin = {k} THEN ']' ELSE ')' END AS label, coalesce(n, 0)::BIGINT AS n FROM "
BIN = "least(floor((covariate - lo) / ((hi - lo) / {k})) + 1, {k})::BIGINT"


RANKED = f"""{V}, p AS (SELECT priority, event, count(*) AS n, count(*) FILTER (WHERE amount > 300000) AS hits FROM versions GROUP BY 1, 2), w AS (SELECT priority, count(*) AS n_entities, round(100.0 * count(*) FILTER (WHERE hits > 0) / count(*), 6) AS flagged_share FROM p GROUP BY 1),
r AS (SELECT *, 'volume' AS ranking, row_number() OVER (PARTITION BY priority ORDER BY n DESC, hits DESC, event) AS rank FROM p UNION ALL SELECT *, 'rate', row_number() OVER (PARTITION BY priority ORDER BY hits / n DESC, n DESC, event) FROM p WHERE n >= 2 UNION ALL SELECT *, 'tail', row_number() OVER (PARTITION BY priority ORDER BY hits / n, n DESC, event) FROM p WHERE n >= 2)
SELECT priority, ranking, rank, event, n, hits, round(100.0 * hits / n, 6) AS pct, n_entities, flagged_share FROM r JOIN w USING (priority) WHERE rank <= 5"""


@query(RANKED)
def entity_rankings(spark, d):
    return b.entity_rankings(s.versions(spark, d).withColumn("big", F.col("amount") > 300000), "priority", "event", "big", best=5, least=2)


@query(f"{V}, t AS (SELECT event, version, strptime(strftime(created, '%Y-%m-%d') || ' ' || CASE WHEN version % 11 = 0 THEN 'n/a' ELSE lpad((version % 24)::VARCHAR, 2, '0') || ':30:00' END, '%Y-%m-%d %H:%M:%S') AS created FROM (SELECT * FROM versions WHERE version % 11 <> 0) UNION ALL SELECT event, version, NULL FROM versions WHERE version % 11 = 0) SELECT event, version, created FROM t QUALIFY row_number() OVER (PARTITION BY event ORDER BY created DESC NULLS LAST, version DESC) = 1")
def latest_by_text_time(spark, d):
    """Versions with a date and a time of day as text; some times are no time."""
    v = F.col("version")
    time = F.when(v % 11 == 0, F.lit("n/a")).otherwise(F.concat(F.lpad((v % 24).cast("string"), 2, "0"), F.lit(":30:00")))
    at = expr.moment(F.date_format("created", "yyyy-MM-dd"), time)
    return ops.latest_version(s.versions(spark, d).select("event", "version", at.alias("created")))


@query(f"WITH {s.CROSSWALK}, x AS (SELECT 'entity' AS side, entity AS k, code AS p, obs FROM crosswalk UNION ALL SELECT 'code', code, entity, obs FROM crosswalk), g AS (SELECT side, k, sum(obs) AS n, count(*) AS partners FROM x GROUP BY 1, 2) SELECT side, count(*) AS n_keys, count(*) FILTER (WHERE n > 1) AS n_repeated, coalesce(sum(n) FILTER (WHERE n > 1), 0)::BIGINT AS n_rows, count(*) FILTER (WHERE partners > 1) AS n_ambiguous, max(partners) AS most_partners FROM g GROUP BY 1")
def pairing_report(spark, d):
    return ops.pairing_report(s.table(spark, d, "lineitem").select(F.col("l_suppkey").alias("entity"), F.col("l_partkey").alias("code")), "entity", "code")


@query("SELECT count(*) AS n_before, (SELECT count(*) FROM (SELECT DISTINCT o_custkey, o_orderstatus FROM orders)) AS n_after FROM orders")
def distinct_counts(spark, d):
    return ops.distinct_counts(s.table(spark, d, "orders").select("o_custkey", "o_orderstatus"))


@query(f"{E}, m AS (SELECT min(covariate) AS lo, max(covariate) AS hi FROM entities), c AS (SELECT {BIN.format(k=20)} AS bin, count(*) AS n FROM entities, m GROUP BY 1), b AS (SELECT unnest(range(1, 21))::BIGINT AS bin) " + HIST.format(by="", k=20) + "b CROSS JOIN m LEFT JOIN c ON c.bin = b.bin")
def histogram_bins(spark, d):
    return b.histogram(s.entities(spark, d), "covariate", 20)


@query(f"{E}, h AS (SELECT unnest(range(min(floor(covariate / 100))::BIGINT, max(ceil(covariate / 100))::BIGINT + 1)) AS bin FROM entities) SELECT bin, count(covariate) AS n FROM h LEFT JOIN entities ON floor(covariate / 100)::BIGINT = bin GROUP BY 1")
def histogram_1pt(spark, d):
    return b.histogram_one_point(s.entities(spark, d).select((F.col("covariate") / 100).alias("v")), "v")


GROUP = "grouped AS (SELECT *, CASE WHEN covariate < -500 THEN 'audited' WHEN covariate < 0 THEN 'validated' WHEN covariate < 3000 THEN 'flagged' ELSE 'corpus' END AS grp FROM entities)"


def grouped(spark, d):
    c = F.col("covariate")
    return s.entities(spark, d).withColumn("grp", b.nested_group(c < -500, c < 0, c < 3000))


@query(f"{E}, {GROUP} SELECT entity, grp FROM grouped")
def nested_group(spark, d):
    return grouped(spark, d).select("entity", "grp")


@query(f"{E}, {GROUP}, m AS (SELECT min(covariate) AS lo, max(covariate) AS hi FROM entities), c AS (SELECT grp, {BIN.format(k=10)} AS bin, count(*) AS n FROM grouped, m GROUP BY 1, 2), b AS (SELECT DISTINCT grp, k.bin FROM grouped, (SELECT unnest(range(1, 11))::BIGINT AS bin) k) " + HIST.format(by="b.grp,", k=10) + "b CROSS JOIN m LEFT JOIN c ON c.bin = b.bin AND c.grp = b.grp")
def histogram_by_group(spark, d):
    return b.histogram(grouped(spark, d), "covariate", 10, by=["grp"])


@query(f"{E}, x AS (SELECT 'covariate' AS dimension, covariate < 1000 AS missing, flag FROM entities UNION ALL SELECT 'segment', segment = 'BUILDING', flag FROM entities), g AS (SELECT dimension, missing, count(flag) AS n, sum(flag::INT)::BIGINT AS hits FROM x GROUP BY 1, 2) SELECT dimension, missing, n, hits, {W} FROM g")
def missingness_rates(spark, d):
    e = s.entities(spark, d).select("flag", F.when(F.col("covariate") >= 1000, F.col("covariate")).alias("covariate"), F.when(F.col("segment") != "BUILDING", F.col("segment")).alias("segment"))
    dims = F.explode(F.array(*[F.struct(F.lit(c).alias("dimension"), F.col(c).isNull().alias("missing")) for c in ("covariate", "segment")]))
    return b.rates(e.select("flag", dims.alias("x")).select("flag", "x.*"), ["dimension", "missing"])


@query("SELECT l_returnflag AS series, year(l_shipdate)::BIGINT AS year, sum(l_quantity) AS quantity, round(sum(l_quantity) / 1e9, 9) AS billions FROM lineitem GROUP BY 1, 2")
def capacity_by_year(spark, d):
    return s.table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("series"), F.year("l_shipdate").cast("bigint").alias("year")).agg(F.sum("l_quantity").alias("quantity"), F.round(F.sum("l_quantity") / 1e9, 9).alias("billions"))


@query("WITH c AS (SELECT l_returnflag AS series, year(l_shipdate)::BIGINT AS year, sum(l_quantity) AS quantity FROM lineitem GROUP BY 1, 2) SELECT series, max(year) AS year, arg_max(quantity, year) AS quantity FROM c GROUP BY 1")
def last_observation(spark, d):
    return capacity_by_year(spark, d).groupBy("series").agg(F.max_by(F.struct("year", "quantity"), "year").alias("x")).select("series", "x.year", "x.quantity")


@query("SELECT l_orderkey, l_linenumber, l_quantity AS quantity FROM lineitem WHERE l_returnflag = 'A' AND l_linestatus = 'O' AND l_quantity IS NOT NULL")
def normalized_filter(spark, d):
    name = F.upper(expr.fold_accents(F.concat(F.lit("á "), F.col("l_returnflag"))))
    keep = s.table(spark, d, "lineitem").where((name == "A A") & (F.upper("l_linestatus") == "O"))
    return keep.select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("string").try_cast("double").alias("quantity")).dropna()


@query("SELECT n_nationkey, lpad(n_nationkey::VARCHAR, 4, '0') AS padded, CASE WHEN n_nationkey = 0 THEN 0 ELSE length(n_nationkey::VARCHAR) END AS level FROM nation")
def code_levels(spark, d):
    code = expr.zero_padded(F.col("n_nationkey").cast("string"), 4)
    n = s.table(spark, d, "nation").select("n_nationkey", code.alias("padded"))
    return n.withColumn("level", F.length(F.ltrim("padded", F.lit("0"))).cast("bigint"))


@query(f"{E} SELECT avg(covariate) IS NOT NULL AS ok, round(regr_slope(covariate, sector), 6) AS slope, round(regr_intercept(covariate, sector), 6) AS intercept, round(regr_r2(covariate, sector), 6) AS r2 FROM entities")
def linear_fit(spark, d):
    y, x = F.col("covariate"), F.col("sector").cast("double")
    return s.entities(spark, d).agg((F.avg(y).isNotNull()).alias("ok"), rounded(F.regr_slope(y, x)).alias("slope"), rounded(F.regr_intercept(y, x)).alias("intercept"), rounded(F.regr_r2(y, x)).alias("r2"))


@query(f"{CODED}, {FLAGS}, x AS (SELECT unnest([{{'f': 'flag', 'v': flag}}, {{'f': 'chemicals', 'v': chemicals}}, {{'f': 'cement', 'v': cement}}]) AS z FROM sample_flags) SELECT z.f AS flag_name, count(z.v) AS n, count(*) FILTER (WHERE z.v) AS hits, round(100.0 * count(*) FILTER (WHERE z.v) / count(z.v), 6) AS pct FROM x GROUP BY 1")
def flag_summary(spark, d):
    z = F.explode(F.array(*[F.struct(F.lit(c).alias("flag_name"), F.col(c).alias("v")) for c in ("flag", "chemicals", "cement")]))
    return sample_flags(spark, d).select(z.alias("z")).groupBy("z.flag_name").agg(as_count(F.count("z.v")).alias("n"), as_count(F.count_if("z.v")).alias("hits"), rounded(percent(F.count_if("z.v"), F.count("z.v"))).alias("pct"))


@query(f"{E}, {GROUP}, x AS (SELECT unnest(CASE grp WHEN 'audited' THEN ['audited', 'validated', 'flagged', 'corpus'] WHEN 'validated' THEN ['validated', 'flagged', 'corpus'] WHEN 'flagged' THEN ['flagged', 'corpus'] ELSE ['corpus'] END) AS sample, covariate, sector::DOUBLE AS sector FROM grouped), y AS (SELECT sample, unnest([{{'k': 'covariate', 'v': covariate}}, {{'k': 'sector', 'v': sector}}]) AS z FROM x) SELECT sample, z.k AS score_name, round(avg(z.v), 6) AS mean, round(stddev_samp(z.v), 6) AS sd, count(z.v) AS n FROM y GROUP BY 1, 2")
def score_by_sample(spark, d):
    c = F.col("covariate")
    sets = F.filter(F.array(F.when(c < -500, F.lit("audited")), F.when(c < 0, F.lit("validated")), F.when(c < 3000, F.lit("flagged")), F.lit("corpus")), lambda x: x.isNotNull())
    scores = F.array(*[F.struct(F.lit(k).alias("score_name"), F.col(k).cast("double").alias("v")) for k in ("covariate", "sector")])
    rows = s.entities(spark, d).select(F.explode(sets).alias("sample"), scores.alias("scores")).select("sample", F.inline("scores"))
    return rows.groupBy("sample", "score_name").agg(rounded(F.avg("v")).alias("mean"), rounded(F.stddev_samp("v")).alias("sd"), as_count(F.count("v")).alias("n"))


@query(f"{E}, x AS (SELECT unnest([{{'c': 'covariate', 'v': covariate}}, {{'c': 'sector', 'v': sector::DOUBLE}}]) AS z FROM entities) SELECT z.c AS column_name, round(avg(z.v), 6) AS mean, round(median(z.v), 6) AS median, min(z.v) AS low, max(z.v) AS high, count(z.v) AS n FROM x GROUP BY 1")
def continuous_summary(spark, d):
    return b.continuous_summary(s.entities(spark, d), ["covariate", "sector"])


@query(f"{V} SELECT count(*) AS n_docs, count(DISTINCT event) AS n_entities, min(created) AS first_at, max(created) AS last_at, round(date_diff('day', min(created), max(created)) / 365.25, 6) AS span_years, count(DISTINCT year(created)) AS n_years, round(count(*) / count(DISTINCT year(created)), 6) AS per_year, round(sum(amount) / 3600, 4) AS total_hours FROM versions")
def dataset_overview(spark, d):
    at, years = F.col("created"), F.count_distinct(F.year("created"))
    return s.versions(spark, d).agg(as_count(F.count(F.lit(1))).alias("n_docs"), as_count(F.count_distinct("event")).alias("n_entities"), F.min(at).alias("first_at"), F.max(at).alias("last_at"), rounded(F.datediff(F.max(at), F.min(at)) / 365.25).alias("span_years"), as_count(years).alias("n_years"), rounded(F.count(F.lit(1)) / years).alias("per_year"), F.round(F.sum("amount") / 3600, 4).alias("total_hours"))


@query(f"{E} SELECT count(DISTINCT CASE WHEN covariate >= 0 THEN entity END) AS n_with_value, count(DISTINCT sector) AS n_sectors, count(DISTINCT country) AS n_countries, round(median(covariate), 6) AS median_value FROM entities")
def coverage_stats(spark, d):
    e = s.entities(spark, d)
    median = quantiles(e, {"covariate": [0.5]})["covariate"][0]
    return e.agg(as_count(F.count_distinct(F.when(F.col("covariate") >= 0, F.col("entity")))).alias("n_with_value"), as_count(F.count_distinct("sector")).alias("n_sectors"), as_count(F.count_distinct("country")).alias("n_countries"), rounded(F.lit(median).cast("double")).alias("median_value"))
