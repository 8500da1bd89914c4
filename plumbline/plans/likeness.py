"""Names that are alike: aliases of buildings, near names within a brand, seeds; each with SQL that compares all with all."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.operators import blocking, phrases, registry, similar
from plumbline.plans.base import LIKENESS, RATIOS, query
from plumbline.sources.files import table

_WINGS = "SELECT s_suppkey AS owner, CASE s_suppkey % 5 WHEN 0 THEN 'abc' WHEN 1 THEN 'abcd' WHEN 2 THEN 'abcdef' WHEN 3 THEN 'xyz' ELSE 'xyzw' END AS name, 1 + s_suppkey % 4 AS n FROM {0} supplier UNION ALL SELECT s_suppkey, 'shared', 2 FROM {0} supplier"
#: Scores of all ``w`` (wanted, name) against all ``al`` (owner, name, n), by the four rules; no filter before them.
_SCORED = f"""s AS (SELECT owner, name, CAST(n AS DOUBLE) / sum(n) OVER (PARTITION BY owner) AS share, CAST(n AS DOUBLE) / sum(n) OVER (PARTITION BY name) AS excl FROM al),
compared AS (SELECT DISTINCT w.name AS x, s.name AS y FROM w, s), {RATIOS},
texts AS (SELECT x, y, least(length(x), length(y)) / greatest(length(x), length(y)) AS r, CASE WHEN x = y THEN 100.0 WHEN starts_with(x, y) OR starts_with(y, x) THEN 80 + 15 * r
  WHEN contains(x, y) OR contains(y, x) THEN 50 + 25 * r WHEN ratio >= 0.6 THEN 60 * ratio END AS score FROM ratios),
scored AS (SELECT wanted, owner, max(CASE WHEN x = y THEN 50 + 50 * (share + excl) / 2 ELSE texts.score * (share + excl) / 2 END) AS score FROM w JOIN texts ON w.name = x JOIN s ON s.name = y WHERE texts.score IS NOT NULL GROUP BY ALL)"""


@query(f"WITH RECURSIVE al AS ({_WINGS.format('')}), w AS (SELECT DISTINCT name AS wanted, name FROM al), {_SCORED} SELECT wanted, owner, round(score, 6) AS score FROM scored")
def scored_aliases(spark, d):
    """Names against the aliases of every building: text match times the alias's share and exclusivity."""
    al = spark.sql(_WINGS.replace("{0} supplier", "{s} supplier"), s=table(spark, d, "supplier"))
    wanted = al.select(F.col("name").alias("wanted")).distinct()
    return similar.alias_scores(wanted, al, "wanted", "wanted", "name", "n", "owner").withColumn("score", F.round("score", 6))


_TITLE = "array_to_string(string_split_regex(lower(text), '[ \\n]+')[1:3], ' ')"


@query(f"""WITH RECURSIVE t AS (SELECT doc_id, source, {_TITLE} AS name FROM documents), al AS (SELECT source AS owner, name, count(*) AS n FROM t WHERE name <> '' GROUP BY ALL),
w AS (SELECT doc_id AS wanted, name FROM t WHERE doc_id % 50 = 0 AND name <> ''), {_SCORED} SELECT wanted, owner, round(score, 6) AS score FROM scored WHERE round(score, 6) >= 0.01""")
def searched_titles(spark, d):
    """Every fiftieth document's opening words, searched among the openings that each source uses (its aliases), ranked by score."""
    words = F.slice(F.split(F.lower("text"), "[ \n]+"), 1, 3)
    t = table(spark, d, "documents").select("doc_id", "source", F.array_join(words, " ").alias("name"))
    aliases = t.where("name <> ''").groupBy("source", "name").agg(F.count(F.lit(1)).alias("n"))
    scores = similar.alias_scores(t.where("doc_id % 50 = 0").withColumnRenamed("doc_id", "wanted"), aliases, "wanted", "name", "name", "n", "source")
    return scores.select("wanted", F.col("source").alias("owner"), F.round("score", 6).alias("score")).where("score >= 0.01").orderBy("wanted", F.desc("score"), "owner")


_CLASSES = "(SELECT DISTINCT p_brand AS brand, p_name AS name FROM part)"


@query(f"""WITH RECURSIVE c AS {_CLASSES}, compared AS (SELECT DISTINCT p.name AS x, q.name AS y FROM c p JOIN c q ON p.brand = q.brand AND p.name < q.name), {RATIOS}, {LIKENESS},
n AS (SELECT p_brand AS brand, p_name AS name, p_size AS size, count(*) AS n FROM part GROUP BY ALL)
SELECT p.brand, x AS a, y AS b, round(similarity, 6) AS similarity, CAST(coalesce(sum(m.n * o.n), 0) AS BIGINT) AS unit_pairs FROM likeness JOIN c p ON p.name = x JOIN c q ON q.name = y AND q.brand = p.brand
LEFT JOIN n m ON m.brand = p.brand AND m.name = x LEFT JOIN n o ON o.brand = p.brand AND o.name = y AND abs(m.size - o.size) <= 3 WHERE similarity >= 0.6 GROUP BY ALL""")
def similar_names(spark, d):
    """Pairs of names of a brand that are alike, and how many pairs of its units with floors within three have them.

    Units are counted by name and floor, so a brand of any size costs what its different names and floors cost.
    """
    p = table(spark, d, "part").select(F.col("p_brand").alias("brand"), F.col("p_name").alias("name"), F.col("p_size").alias("size"))
    pairs = similar.similar_classes(p, "name", ["brand"])
    n = p.groupBy("brand", "name", "size").agg(F.count(F.lit(1)).alias("n"))
    one = n.select("brand", F.col("name").alias("a"), "size", F.col("n").alias("m"))
    two = n.select("brand", F.col("name").alias("b"), F.explode(F.sequence(F.col("size") - 3, F.col("size") + 3)).alias("size"), "n")
    units = pairs.join(one, ["brand", "a"]).join(two, ["brand", "b", "size"]).groupBy("brand", "a", "b").agg(F.sum(F.col("m") * F.col("n")).alias("unit_pairs"))
    return pairs.join(units, ["brand", "a", "b"], "left").select("brand", "a", "b", F.round("similarity", 6).alias("similarity"), F.coalesce("unit_pairs", F.lit(0)).alias("unit_pairs"))


@query(f"""WITH RECURSIVE c AS (SELECT p_brand AS brand, p_name AS name, min(p_partkey) AS k FROM part GROUP BY ALL), compared AS (SELECT DISTINCT p.name AS x, q.name AS y FROM c p JOIN c q ON p.brand = q.brand AND p.k > q.k), {RATIOS},
near AS (SELECT p.brand, p.k, q.k AS o FROM c p JOIN c q ON p.brand = q.brand AND p.k > q.k JOIN ratios ON x = p.name AND y = q.name WHERE ratio >= 0.7),
ordered AS (SELECT brand, name, k, row_number() OVER (PARTITION BY brand ORDER BY k) AS rn, coalesce(list(o ORDER BY o) FILTER (o IS NOT NULL), []) AS others FROM c LEFT JOIN near USING (brand, k) GROUP BY brand, name, k),
walk AS (SELECT DISTINCT brand, CAST(0 AS BIGINT) AS rn, CAST([] AS BIGINT[]) AS seeds FROM c UNION ALL
  SELECT w.brand, o.rn, CASE WHEN list_has_any(o.others, w.seeds) THEN w.seeds ELSE list_append(w.seeds, o.k) END FROM walk w JOIN ordered o ON o.brand = w.brand AND o.rn = w.rn + 1),
last AS (SELECT brand, arg_max(seeds, rn) AS seeds FROM walk GROUP BY brand)
SELECT p_partkey AS "key", CAST(CASE WHEN list_contains(seeds, o.k) THEN o.k ELSE list_min(list_intersect(o.others, seeds)) END AS BIGINT) AS seed FROM part JOIN ordered o ON brand = p_brand AND name = p_name JOIN last ON last.brand = o.brand""")
def seeded_names(spark, d):
    """Units of a brand in order of their number, each with the first whose name is alike."""
    return similar.group_by_seed(table(spark, d, "part"), "p_brand", "p_partkey", "p_name", 0.7)


@query(f"""WITH RECURSIVE t AS (SELECT DISTINCT source, {_TITLE} AS name FROM documents WHERE {_TITLE} <> ''), p AS (SELECT a.source, a.name AS x, b.name AS y FROM t a JOIN t b ON a.source = b.source AND a.name < b.name),
compared AS (SELECT DISTINCT x, y FROM p), {RATIOS}, {LIKENESS} SELECT source, x AS a, y AS b, round(similarity, 6) AS similarity FROM p JOIN likeness USING (x, y) WHERE similarity >= 0.6""")
def similar_openings(spark, d):
    """Different opening words of a source's documents that are alike."""
    words = F.slice(F.split(F.lower("text"), "[ \n]+"), 1, 3)
    t = table(spark, d, "documents").select("source", F.array_join(words, " ").alias("name"))
    return similar.similar_classes(t, "name", ["source"]).withColumn("similarity", F.round("similarity", 6))


_BUILDINGS = """SELECT p_partkey AS id, CASE WHEN p_partkey % 13 <> 0 THEN p_name || ' ' || CAST(p_partkey % 90 AS VARCHAR(9)) END AS name, CASE p_partkey % 5 WHEN 0 THEN p_name || '東棟' WHEN 1 THEN substr(p_name, 3) ELSE p_name END AS canonical,
CASE WHEN p_partkey % 17 <> 0 THEN p_brand || '-' || CAST(p_size AS VARCHAR(9)) END AS address, p_size AS floors, CASE WHEN p_partkey % 7 <> 0 THEN p_partkey % 23 END AS units, CASE WHEN p_partkey % 11 <> 0 THEN 1960 + p_partkey % 40 END AS year FROM {0}"""
_PLACED = f"b AS (SELECT id, name, canonical, string_split(address, '-')[1] AS prefix, floors, units, year FROM ({_BUILDINGS.format('part')}))"
_MATCH = "coalesce(p.canonical <> '' AND q.canonical <> '' AND (contains(p.canonical, q.canonical) OR contains(q.canonical, p.canonical) OR (length(p.canonical) >= 5 AND length(q.canonical) >= 5 AND left(p.canonical, 5) = left(q.canonical, 5))), false)"


def _buildings(spark, d):
    return spark.sql(_BUILDINGS.format("{parts}"), parts=table(spark, d, "part")).withColumn("prefix", blocking.address_prefix(F.col("address")))


@query(f"""WITH {_PLACED}, c AS (SELECT min(id) AS id, name, canonical, prefix, floors, units, year FROM b GROUP BY ALL)
SELECT p.id AS a, q.id AS b FROM c p JOIN c q ON p.id < q.id AND (p.name = q.name OR (p.prefix IS NOT DISTINCT FROM q.prefix AND (
(p.floors = q.floors AND p.units = q.units AND abs(p.year - q.year) <= 1) OR (p.floors = q.floors AND p.year = q.year) OR ({_MATCH} AND (p.floors = q.floors OR p.units = q.units OR p.year = q.year)))))""")
def candidate_building_pairs(spark, d):
    """Pairs of different buildings that any of the six rules makes candidates, each once."""
    return blocking.candidate_pairs(blocking.classes(_buildings(spark, d)))


@query(f"""WITH {_PLACED}, g AS (SELECT prefix, floors, units FROM (SELECT *, year - lag(year) OVER (PARTITION BY prefix, floors, units ORDER BY year) AS gap FROM b WHERE floors IS NOT NULL AND units IS NOT NULL) GROUP BY ALL HAVING count(*) > 1 AND count(*) = count(year) AND min(gap) <= 1),
r AS (SELECT id, 'floors_units' AS rule FROM b JOIN g ON b.prefix IS NOT DISTINCT FROM g.prefix AND b.floors = g.floors AND b.units = g.units UNION ALL SELECT p.id, 'name' FROM b p JOIN b q ON p.id <> q.id AND p.name = q.name
UNION ALL SELECT p.id, unnest(list_filter([CASE WHEN p.floors = q.floors AND p.year = q.year THEN 'floors_year' END, CASE WHEN {_MATCH} AND p.floors = q.floors THEN 'floors_matching' END,
CASE WHEN {_MATCH} AND p.units = q.units THEN 'units_matching' END, CASE WHEN {_MATCH} AND p.year = q.year THEN 'year_matching' END], lambda x: x IS NOT NULL)) FROM b p JOIN b q ON p.id <> q.id AND p.prefix IS NOT DISTINCT FROM q.prefix)
SELECT id, string_agg(DISTINCT rule, ',' ORDER BY rule) AS rules FROM r GROUP BY id""")
def candidate_buildings(spark, d):
    """Buildings that some other one makes candidates, and the rules that say so."""
    return blocking.candidate_ids(_buildings(spark, d)).select("id", F.array_join("rules", ",").alias("rules"))


#: Words that say nothing at the ends of an opening; the table of phrases is every one and every two of them.
LITTLE = ["de", "la", "le", "les", "et", "en", "un", "une", "des", "que", "qui", "est", "the", "of", "and", "to", "in", "is", "der", "die", "das", "und", "el", "los", "con", "por"]
_ANY = "|".join(sorted(phrases.chained(LITTLE), key=lambda p: (-len(p), p)))
_YNA = "|".join(p[::-1] for p in sorted(phrases.chained(LITTLE), key=lambda p: (-len(p), p)))
_LEFT, _RIGHT = (f"'^(?:[^\\p{{L}}\\p{{N}}]*(?:{words})(?:[^\\p{{L}}\\p{{N}}]+|$))+', ''" for words in (_ANY, _YNA))
_OPENING = "regexp_replace(array_to_string(string_split_regex(lower(text), '[ \\n]+')[1:7], ' '), '[^\\p{L}\\p{N} ]', '', 'g')"


@query(f"""WITH t AS (SELECT doc_id, trim({_OPENING}) AS opening FROM documents) SELECT doc_id, opening, trim(reverse(regexp_replace(reverse(regexp_replace(opening, {_LEFT})), {_RIGHT}))) AS stripped FROM t""")
def stripped_openings(spark, d):
    """Opening words of documents without the little words, and pairs of them, at both ends."""
    words = F.array_join(F.slice(F.split(F.lower("text"), "[ \n]+"), 1, 7), " ")
    t = table(spark, d, "documents").select("doc_id", F.trim(F.regexp_replace(words, r"[^\p{L}\p{N} ]", "")).alias("opening"))
    return t.select("doc_id", "opening", phrases.stripped(F.col("opening"), phrases.chained(LITTLE)).alias("stripped"))


_COLOURS = ["red", "blue", "green", "hot", "cold", "small", "large", "old", "new"]


@query(f"SELECT p_partkey, p_name, trim(regexp_replace(p_name, '^(?:(?:{'|'.join(_COLOURS)})(?: +|$))+', '')) AS stripped FROM part")
def stripped_names(spark, d):
    """Names of parts without their colours and sizes; the table of phrases is read as a frame."""
    words = spark.createDataFrame([(w,) for w in phrases.chained(_COLOURS, 3)], "phrase string")
    return table(spark, d, "part").select("p_partkey", "p_name", phrases.stripped(F.col("p_name"), words).alias("stripped"))


_NO = "CAST(substr(p_brand, 7) AS INT)"
_PLACE = "'東京都' || CASE WHEN {n} % 3 = 0 THEN '港区' ELSE '中央区' END || '芝' || CAST({n} AS VARCHAR(9)) || CASE WHEN {k} % 4 <> 0 THEN '-' || CAST({k} % 3 + 1 AS VARCHAR(9)) ELSE '' END"
_REGISTERED = f"""SELECT id, name, CASE WHEN id % 19 <> 0 THEN {_PLACE.format(n='n', k='id')} END AS address, CASE WHEN id % 5 <> 0 THEN CAST(id % 3 + 5 AS INT) END AS floors, CASE WHEN id % 6 <> 0 THEN CAST(1990 + id % 2 AS INT) END AS year,
CASE WHEN id % 7 <> 0 THEN CAST(1 + id % 3 AS INT) END AS month, CASE WHEN id % 8 <> 0 THEN CAST(20 + id % 4 AS INT) END AS units FROM (SELECT min(p_partkey) AS id, p_name AS name, {_NO} AS n FROM {{0}} WHERE p_partkey % 3 <> 0 GROUP BY p_name, p_brand)"""
_OFFERED = f"""SELECT p_partkey AS key, 's' || CAST(p_partkey % 3 AS VARCHAR(9)) AS site, CASE WHEN p_partkey % 4 = 0 THEN 'e' || CAST(p_partkey % 500 AS VARCHAR(9)) END AS external_id, CASE p_partkey % 7 WHEN 0 THEN p_name || '東' WHEN 1 THEN left(p_name, 6) WHEN 2 THEN NULL ELSE p_name END AS name,
CASE WHEN p_partkey % 23 <> 0 THEN {_PLACE.format(n=_NO, k='(p_partkey + p_size)')} END AS address, CASE WHEN p_partkey % 4 <> 0 THEN CAST(p_size % 3 + 5 AS INT) END AS floors, CASE WHEN p_size % 5 <> 0 THEN CAST(1990 + p_size % 2 AS INT) END AS year,
CASE WHEN p_size % 3 <> 0 THEN CAST(1 + p_size % 3 AS INT) END AS month, CASE WHEN p_partkey % 9 <> 0 THEN CAST(20 + p_size % 4 AS INT) END AS units FROM {{0}}"""
_ENTRIES = "SELECT 's' || CAST(p_partkey % 3 AS VARCHAR(9)) AS site, 'e' || CAST(p_partkey % 500 AS VARCHAR(9)) AS external_id, p_partkey AS id FROM {0} WHERE p_partkey % 8 = 0"
_CALLED = "SELECT id, name AS alias, 1 + id % 3 AS n FROM r UNION ALL SELECT id, name || '東', 2 FROM r WHERE id % 4 = 0 UNION ALL SELECT id, left(name, 6), 1 FROM r WHERE id % 5 = 0 AND length(name) > 6"
_PAIR = """CASE WHEN a.address = r.address THEN 100 WHEN substr(a.address, 1, strpos(a.address, '芝')) <> substr(r.address, 1, strpos(r.address, '芝')) THEN 0
WHEN string_split(string_split(a.address, '芝')[2], '-')[1] <> string_split(string_split(r.address, '芝')[2], '-')[1] THEN 80 WHEN string_split(a.address, '-')[2] = string_split(r.address, '-')[2] THEN 100 ELSE 90 END AS points"""


@query(f"""WITH RECURSIVE r AS ({_REGISTERED.format('part')}), offered AS ({_OFFERED.format('part')}), entries AS (SELECT site, external_id, min(id) AS id FROM ({_ENTRIES.format('part')}) WHERE id IN (SELECT id FROM r) GROUP BY ALL),
o AS (SELECT site, coalesce(external_id, '#' || coalesce(address, '?') || '|' || name || '|' || coalesce(floors, 0) || '|' || coalesce(year, 0) || '|' || coalesce(month, 0) || '|' || coalesce(units, 0)) AS ext, * EXCLUDE (site, external_id) FROM offered WHERE name <> ''),
lead AS (SELECT *, row_number() OVER (PARTITION BY site, ext ORDER BY key) AS turn, first_value(key) OVER (PARTITION BY site, ext ORDER BY key) AS leader FROM o WHERE NOT EXISTS (SELECT 1 FROM entries e WHERE e.site = o.site AND e.external_id = o.ext)),
a AS (SELECT *, (SELECT count(*) FROM r WHERE r.address = lead.address AND (starts_with(r.name, lead.name) OR starts_with(lead.name, r.name))) >= 2 AS unsure FROM lead WHERE turn = 1),
al AS (SELECT id AS owner, alias AS name, n FROM ({_CALLED})), s AS (SELECT owner, name, CAST(n AS DOUBLE) / sum(n) OVER (PARTITION BY owner) AS share, CAST(n AS DOUBLE) / sum(n) OVER (PARTITION BY name) AS excl FROM al),
compared AS (SELECT DISTINCT w.name AS x, s.name AS y FROM (SELECT DISTINCT name FROM a) w, (SELECT DISTINCT name FROM s) s), {RATIOS},
texts AS (SELECT x, y, least(length(x), length(y)) / greatest(length(x), length(y)) AS q, CASE WHEN x = y THEN 100.0 WHEN starts_with(x, y) OR starts_with(y, x) THEN 80 + 15 * q WHEN contains(x, y) OR contains(y, x) THEN 50 + 25 * q WHEN ratio >= 0.6 THEN 60 * ratio END AS score FROM ratios),
scored AS (SELECT x AS name, owner AS id, max(CASE WHEN x = y THEN 50 + 50 * (share + excl) / 2 ELSE texts.score * (share + excl) / 2 END) AS sure, max(CASE WHEN x = y THEN 95 * (share + excl) / 2 ELSE texts.score * (share + excl) / 2 END) AS doubted FROM texts JOIN s ON s.name = y WHERE texts.score IS NOT NULL GROUP BY ALL),
met AS (SELECT a.key, r.id, a.unsure, a.name AS x, r.name AS y, a.address AS ax, r.address AS ay, {_PAIR}, coalesce(a.floors = r.floors, false) AS f, a.floors <> r.floors IS TRUE AS f_no, coalesce(a.year = r.year, false) AS y_same, a.year <> r.year IS TRUE AS y_no, a.month <> r.month IS TRUE AS m_no,
  abs(a.month - r.month) <= 1 AS m_near, coalesce(a.units = r.units, false) AS u, a.units <> r.units IS TRUE AS u_no, abs(a.units - r.units) <= 2 AS u_near FROM a JOIN r ON a.address <> '' AND r.address <> ''),
judged AS (SELECT *, NOT (f_no OR y_no OR m_no OR u_no) AS strict, NOT f_no AND NOT y_no AND (CAST(f AS INT) + CAST(y_same AND NOT m_no AS INT) + CAST(u AS INT) < 2 OR NOT ((y_same AND m_no) OR u_no) OR (f AND u AND y_same AND m_no AND m_near) OR ((f OR (y_same AND NOT m_no)) AND u_no AND u_near)) AS fair FROM met),
total AS (SELECT j.*, points * 0.4 + CASE WHEN strict THEN 30 WHEN fair THEN 21 ELSE 0 END + 0.3 * coalesce(CASE WHEN unsure THEN doubted ELSE sure END, 0) AS total FROM judged j LEFT JOIN scored s ON s.name = j.x AND s.id = j.id),
st AS (SELECT *, 1 AS stage FROM total WHERE x = y AND points >= 40 AND fair
  UNION ALL SELECT *, 2 FROM total WHERE (starts_with(ax, ay) OR starts_with(ay, ax)) AND (strict OR fair) AND (EXISTS (SELECT 1 FROM al WHERE al.owner = total.id AND al.name = x) OR (unsure AND ax = ay AND (starts_with(x, y) OR starts_with(y, x))))
  UNION ALL SELECT *, 3 FROM total WHERE points >= 40 AND (contains(x, y) OR contains(y, x)) AND (contains(ax, ay) OR contains(ay, ax))),
ranked AS (SELECT key, id, stage, unsure, total - lead(total) OVER w AS gap, row_number() OVER w AS rn FROM st WINDOW w AS (PARTITION BY key, stage ORDER BY round(total, 9) DESC, id)),
hit AS (SELECT key, arg_min(id, stage) AS id, min(stage) AS stage FROM ranked WHERE rn = 1 AND NOT (stage > 1 AND unsure AND coalesce(gap < 5, false)) GROUP BY key),
led AS (SELECT a.key, CAST(hit.id AS VARCHAR) AS building, CASE stage WHEN 1 THEN 'name' WHEN 2 THEN 'alias' WHEN 3 THEN 'partial' ELSE 'new' END AS how, a.name, a.address FROM a LEFT JOIN hit USING (key))
SELECT key, coalesce(building, name || '@' || coalesce(address, '')) AS building, how FROM led UNION ALL SELECT l.key, coalesce(g.building, g.name || '@' || coalesce(g.address, '')), 'external' FROM lead l JOIN led g ON g.key = l.leader WHERE turn > 1
UNION ALL SELECT o.key, CAST(e.id AS VARCHAR), 'external' FROM o JOIN entries e ON e.site = o.site AND e.external_id = o.ext""")
def found_buildings(spark, d):
    """The building of every advert: by its external id, by name, alias or part, or a new one, told here by its name and address."""
    p = table(spark, d, "part")
    buildings = spark.sql(_REGISTERED.replace("{0}", "{p}"), p=p)
    offered = spark.sql(_OFFERED.replace("{0}", "{p}"), p=p)
    assigned, _, _ = registry.find_or_create(offered, buildings, spark.sql(_ENTRIES.replace("{0}", "{p}"), p=p), spark.sql(_CALLED.replace("FROM r", "FROM {r}"), r=buildings))
    made = assigned.where("how = 'new'").join(offered, "key").select("id", F.concat("name", F.lit("@"), F.coalesce("address", F.lit(""))).alias("_new")).distinct()
    return assigned.join(made, "id", "left").select("key", F.coalesce("_new", F.col("id").cast("string")).alias("building"), "how")
