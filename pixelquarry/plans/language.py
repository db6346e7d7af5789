"""Queries on requests: one request for each event, in the words of a fixed list."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelquarry.functions import lexicon
from pixelquarry.operators import language
from pixelquarry.sources.scenes import read

QUERIES: dict = {}
SQL: dict[str, str] = {}

REQUESTS = (
    "Where is the water in the northern part?",
    "How many buildings larger than 2.5 ha are there?",
    "Show me the 3 largest fields in the top left",
    "What changed between the two dates?",
    "Detect changes",
    "Describe the image",
    "Generate a caption for the lake",
    "How much vegetation and bare soil is there?",
    "Combine optical and SAR backscatter",
    "Locate settlements no more than 40 pixels",
    "Find the roads near the river",
    "Which fallow field is in the south east?",
    "Segment the image",
    "Is there water?",
    "Classify the land cover",
    "Outline forests of at least 2 sq. km and under 10 km²",
    "Produce a report",
    "hello there",
    "where are the ships",
    "two smallest ponds, bottom right",
    "what is in this image",
    "rooftop area over 3 acres",
    "compare the cropland before and after",
    "count the lakes in the centre",
)


def query(name: str, oracle: str | None = None):
    def add(f):
        QUERIES[name] = f
        if oracle:
            SQL[name] = oracle
        return f

    return add


#: Parts of requests that are put together from an event's number: {n} and {m} are numbers of its own.
LEADS = ("where is the", "how many", "show me the", "how much", "find the", "total area of", "is there", "describe the")
COUNTS = ("", "3 largest", "two smallest", "largest", "", "top 5 biggest", "largest and smallest", "0 widest", "12 narrowest")
NOUNS = (
    "water", "buildings", "fallow field and field", "forests", "bare soil", "built-up areas", "lakes near the road", "ships", "water and trees", "nothing here",
    "rooftops", "eastern farmland", "ploughed fields", "flooded areas", "soil",
)
BOUNDS = (
    "", "larger than {n} ha", "no more than {n}.5 acres", "at least {n} px", "{n} m²", "over {n} ha and under {m} km²", "up to {n} pixels", "exceeding {n} square metres, below {m} hectares",
    "more than {m} px 7 ha {n} pixels", "not more than {m}.25 sq. km", "", "above about 0.4 pixels", "of at most {n} hectare and at least {m} m^2",
)
PLACES = ("", "in the northern part", "in the top left", "south-east", "bottom half, north", "in the middle", "", "Upper RIGHT", "westward")


def requests(spark: SparkSession, sf: str) -> DataFrame:
    """One request for each event: a sentence of the list, or one put together; some are empty or too
    long."""
    e = F.col("event_id")
    part = lambda table, k: F.element_at(F.array(*map(F.lit, table)), (F.floor(e / k) % len(table) + 1).cast("int"))
    numbers = (("{n}", e % 60 + 1), ("{m}", e % 9 + 1))
    bound = part(BOUNDS, 11)
    for mark, number in numbers:
        bound = F.replace(bound, F.lit(mark), number.cast("string"))
    made = F.concat_ws(" ", part(LEADS, 2), part(COUNTS, 7), part(NOUNS, 3), bound, part(PLACES, 5))
    query = F.when(e % 3 == 0, part(REQUESTS, 3)).when(e % 97 == 1, "  ").when(e % 101 == 1, F.repeat(F.concat(made, F.lit(" ")), 40)).otherwise(made)
    n = e % 4
    return read(spark, sf, "events").select(
        e.alias("request_id"),
        query.alias("query"),
        n.cast("int").alias("n_images"),
        F.least(n, F.floor(e / 4) % 3).cast("int").alias("n_sar"),
    ).withColumn("n_optical", F.col("n_images") - F.col("n_sar"))


def _quote(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _part(table: tuple[str, ...], k: int) -> str:
    return "list_extract([" + ", ".join(map(_quote, table)) + f"], ((event_id // {k}) % {len(table)} + 1)::INT)"


_MADE = f"concat_ws(' ', {_part(LEADS, 2)}, {_part(COUNTS, 7)}, {_part(NOUNS, 3)}, replace(replace({_part(BOUNDS, 11)}, '{{n}}', (event_id % 60 + 1)::VARCHAR), '{{m}}', (event_id % 9 + 1)::VARCHAR), {_part(PLACES, 5)})"
_REQ = (
    f"rq AS (SELECT event_id AS request_id, CASE WHEN event_id % 3 = 0 THEN {_part(REQUESTS, 3)} WHEN event_id % 97 = 1 THEN '  ' WHEN event_id % 101 = 1 THEN repeat({_MADE} || ' ', 40) ELSE {_MADE} END AS query, "
    "(event_id % 4)::INT AS n_images, least(event_id % 4, (event_id // 4) % 3)::INT AS n_sar FROM events)"
)
_X01 = r"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(replace(replace(lower(query), '²', '2'), '^2', '2'), 'sq.', 'sq '), '[^a-z0-9.]+', ' ', 'g'), '(^|[^0-9])\.([^0-9]|$)', '\1 \2', 'g'), '(^|[^0-9])\.([^0-9]|$)', '\1 \2', 'g'), '\s+', ' ', 'g'))"
_X02 = "trim(regexp_replace(lower(query), '[^a-z0-9]+', ' ', 'g'))"


@query("normalise_query", f"WITH {_REQ} SELECT request_id, {_X01} AS vocabulary, {_X02} AS tasks FROM rq")
def normalise_query(spark: SparkSession, sf: str) -> DataFrame:
    q = F.col("query")
    return requests(spark, sf).select("request_id", language.normalise(q).alias("vocabulary"), language.normalise_for_tasks(q).alias("tasks"))


_TASKS = ", ".join(f"({_quote(t)}, {_quote(p)}, {w})" for t, ps in lexicon.TASKS.items() for p, w in ps)
_TIES = ", ".join(f"({_quote(t)}, {i})" for i, t in enumerate(lexicon.TIES))
_CLASSIFY = f"""WITH {_REQ}, lx(task, phrase, w) AS (VALUES {_TASKS}), ti(task, o) AS (VALUES {_TIES}),
sc AS (SELECT request_id, task, sum(w) AS score FROM rq JOIN lx ON contains(' ' || {_X02} || ' ', ' ' || phrase || ' ') GROUP BY 1, 2),
be AS (SELECT request_id, task, score FROM sc JOIN ti USING (task) QUALIFY row_number() OVER (PARTITION BY request_id ORDER BY score DESC, o) = 1),
cl AS (SELECT rq.request_id, n_images, n_sar, n_images - n_sar AS n_optical, coalesce(score, 0)::BIGINT AS score, CASE WHEN coalesce(score, 0) < 2 THEN 'unknown'
  WHEN be.task = 'change_detection' AND (contains(query, '?') OR split_part({_X02}, ' ', 1) IN ({', '.join(map(_quote, lexicon.QUESTION_WORDS))})) THEN 'change_vqa' ELSE be.task END AS task
  FROM rq LEFT JOIN be USING (request_id))"""


@query("classify_request", f"{_CLASSIFY} SELECT request_id, task, score FROM cl")
def classify_request(spark: SparkSession, sf: str) -> DataFrame:
    return language.classify(requests(spark, sf))


_ROUTE = f"""{_CLASSIFY}, ro AS (SELECT *, CASE WHEN n_images = 1 AND n_sar = 1 THEN 'optical_sar_analysis' WHEN n_images = 1 THEN 'land_cover_analysis' WHEN n_images = 2 AND n_sar = 0 THEN 'change_detection'
  WHEN n_images = 2 AND n_sar = 1 AND n_optical = 1 THEN 'optical_sar_analysis' WHEN n_images = 2 AND n_sar = 2 THEN 'change_detection' ELSE 'unknown' END AS df,
  CASE WHEN task IN ('vqa', 'captioning') AND n_images = 1 AND n_sar = 1 THEN 'optical_sar_analysis'
  WHEN task IN ('vqa', 'captioning', 'land_cover_analysis', 'grounding') AND n_images = 2 AND n_sar = 1 AND n_optical = 1 THEN 'optical_sar_analysis'
  WHEN task IN ('vqa', 'captioning', 'land_cover_analysis', 'grounding') AND n_images = 2 AND n_sar <> 1 THEN 'change_detection' END AS ov FROM cl),
rr AS (SELECT *, CASE WHEN task = 'unknown' THEN df ELSE coalesce(ov, task) END AS routed FROM ro)
SELECT request_id, task, routed, CASE WHEN routed = 'unknown' THEN 'unresolved' WHEN task = 'unknown' THEN 'input_default' WHEN ov IS NOT NULL THEN 'input_override' ELSE 'classifier' END AS source FROM rr"""


@query("route_request", _ROUTE)
def route_request(spark: SparkSession, sf: str) -> DataFrame:
    rows = requests(spark, sf)
    routed = language.route(language.classify(rows).join(rows.drop("query"), "request_id"))
    return routed.select("request_id", "task", "routed", "source")


_LEX = ", ".join(f"({_quote(k)}, {_quote(n)}, {_quote(p)})" for k, n, p, _ in language.lexicon_rows() if k != "task")
#: Every place of every phrase, by the words of a text; tg are the target phrases that no longer one holds.
_HITS = f"""{_REQ}, nt AS MATERIALIZED (SELECT request_id, query, {_X01} AS t FROM rq), lx(kind, name, phrase) AS (VALUES {_LEX}), wd AS (SELECT request_id, string_split(t, ' ') AS w FROM nt),
gr AS (SELECT request_id, i, k, array_to_string(w[i:i+k-1], ' ') AS phrase FROM wd, unnest(range(1, len(w) + 1)) g(i), range(1, 6) h(k) WHERE i + k - 1 <= len(w)),
ht AS MATERIALIZED (SELECT request_id, kind, name, phrase, i AS a, i + k - 1 AS u FROM gr JOIN lx USING (phrase)),
tg AS MATERIALIZED (SELECT * FROM ht x WHERE kind = 'target' AND NOT EXISTS (SELECT 1 FROM ht y WHERE y.kind = 'target' AND y.request_id = x.request_id AND y.a <= x.a AND y.u >= x.u AND y.u - y.a > x.u - x.a))"""


@query("request_targets", f"WITH {_HITS} SELECT request_id, name, phrase, count(*) AS n FROM tg GROUP BY ALL")
def request_targets(spark: SparkSession, sf: str) -> DataFrame:
    hits = language.matches(requests(spark, sf), language.normalise(F.col("query")), ["target"])
    return language.targets(hits).groupBy("request_id", "name", "phrase").agg(F.count("*").alias("n"))


_COMPARATORS = ", ".join(f"({_quote(k)}, {_quote(p)})" for k, ps in lexicon.COMPARATORS.items() for p in ps)
_UNITS = ", ".join(f"({_quote(u)}, {float(f)}::DOUBLE)" for u, f in lexicon.AREA_UNITS.items()) + ", " + ", ".join(f"({_quote(u)}, NULL)" for u in lexicon.PIXEL_UNITS)
_SIZE = "'(\\d+(?:\\.\\d+)?)\\s*(" + "|".join([*lexicon.AREA_UNITS, *lexicon.PIXEL_UNITS]) + ")\\b'"
_SUPER = "|".join(lexicon.LARGEST + lexicon.SMALLEST)
_WORDS_TO_TEN = ", ".join(f"({_quote(w)}, {i + 1})" for i, w in enumerate(lexicon.NUMBER_WORDS))
_any = lambda column, phrases: "(" + " OR ".join(f"contains({column}, {_quote(p)})" for p in phrases) + ")"
_REFUSAL = """CASE WHEN trim(query) = '' THEN 'empty' WHEN length(query) > 1000 THEN 'too_long' WHEN EXISTS (SELECT 1 FROM ht WHERE ht.request_id = nt.request_id AND kind = 'relation') THEN 'spatial_relation'
  WHEN EXISTS (SELECT 1 FROM ht WHERE ht.request_id = nt.request_id AND kind = 'unsupported') THEN 'unsupported_object' END"""
#: CTE pg: the parsed requests.
_PARSED = f"""{_HITS},
tp AS (SELECT request_id, count(DISTINCT name) AS classes, arg_min(name, a - 1000*length(phrase)) AS target, arg_min(phrase, a - 1000*length(phrase)) AS phrase FROM tg GROUP BY 1),
er AS (SELECT request_id, coalesce({_REFUSAL}, CASE WHEN classes IS NULL THEN 'no_target' WHEN classes > 1 THEN 'several_targets' END) AS error FROM nt LEFT JOIN tp USING (request_id)),
rf AS (SELECT request_id, arg_min(phrase, a*1000 - length(phrase)) AS refused FROM ht JOIN er USING (request_id) WHERE (error = 'spatial_relation' AND kind = 'relation') OR (error = 'unsupported_object' AND kind = 'unsupported') GROUP BY 1),
bl AS (SELECT request_id, string_split(replace(t, phrase, repeat(' ', length(phrase))), ' ') AS w FROM nt JOIN tp USING (request_id)),
bg AS (SELECT request_id, i, array_to_string(w[i:i+k-1], ' ') AS phrase FROM bl, unnest(range(1, len(w) + 1)) g(i), range(1, 3) h(k) WHERE i + k - 1 <= len(w)),
se AS (SELECT request_id, kind, arg_min(name, i*1000 - length(phrase)) AS name, arg_min(phrase, i*1000 - length(phrase)) AS phrase FROM bg JOIN lx USING (phrase) WHERE kind IN ('compass', 'frame') GROUP BY 1, 2),
su AS (SELECT request_id, count(DISTINCT name) AS k, any_value(name) AS name FROM ht WHERE kind = 'superlative' GROUP BY 1),
nw(word, n) AS (VALUES {_WORDS_TO_TEN}),
li AS (SELECT request_id, coalesce(nw.n, try_cast(word AS INT)) AS n FROM (SELECT request_id, regexp_extract(t, '\\b(\\d+|{"|".join(lexicon.NUMBER_WORDS)})\\s+({_SUPER})\\b', 1) AS word FROM nt) LEFT JOIN nw USING (word)),
cm(kind, phrase) AS (VALUES {_COMPARATORS}), un(unit, factor) AS (VALUES {_UNITS}),
ms AS (SELECT request_id, regexp_extract_all(t, {_SIZE}) AS m, regexp_split_to_array(t, {_SIZE}) AS b FROM nt),
mi AS (SELECT request_id, i, m[i] AS m, right(coalesce(array_to_string(list_transform(range(1, i), lambda j: b[j] || m[j]), ''), '') || b[i], 40) AS before FROM ms, unnest(range(1, len(m) + 1)) g(i)),
mk AS (SELECT request_id, i, any_value(m) AS m, arg_max(kind, (length(before) - instr(reverse(before), reverse(phrase)))*100 + length(phrase)) AS kind FROM mi JOIN cm ON contains(before, phrase) GROUP BY 1, 2),
mu AS (SELECT request_id, i, kind, regexp_extract(m, {_SIZE}, 1)::DOUBLE AS x, factor FROM mk JOIN un ON unit = regexp_extract(m, {_SIZE}, 2)),
bo AS (SELECT request_id, arg_max(x*factor, i) FILTER (kind = 'min' AND factor IS NOT NULL) AS min_area_m2, arg_max(x*factor, i) FILTER (kind = 'max' AND factor IS NOT NULL) AS max_area_m2,
  arg_max(greatest(1, round_even(x, 0)), i) FILTER (kind = 'min' AND factor IS NULL)::INT AS min_pixels, arg_max(greatest(1, round_even(x, 0)), i) FILTER (kind = 'max' AND factor IS NULL)::INT AS max_pixels FROM mu GROUP BY 1),
pa AS (SELECT nt.request_id, error, refused, tp.target, tp.phrase AS target_phrase, coalesce(c.name, f.name) AS sector, coalesce(c.phrase, f.phrase) AS sector_phrase, c.name IS NULL AND f.name IS NOT NULL AS frame_relative,
  CASE WHEN su.k = 1 THEN su.name END AS superlative, CASE WHEN su.k = 1 THEN greatest(1, coalesce(li.n, 1)) END::INT AS "limit", min_area_m2, max_area_m2, min_pixels, max_pixels,
  {_any('t', language.COUNT_PHRASES)} AS wants_count, {_any('t', language.AREA_PHRASES)} AS wants_area
FROM nt JOIN er USING (request_id) LEFT JOIN rf USING (request_id) LEFT JOIN tp USING (request_id) LEFT JOIN su USING (request_id) LEFT JOIN li USING (request_id) LEFT JOIN bo USING (request_id)
LEFT JOIN se c ON c.request_id = nt.request_id AND c.kind = 'compass' LEFT JOIN se f ON f.request_id = nt.request_id AND f.kind = 'frame'),
pg AS MATERIALIZED (SELECT request_id, error, refused, """ + ", ".join(f'CASE WHEN error IS NULL THEN "{c}" END AS "{c}"' for c in (
    "target", "target_phrase", "sector", "sector_phrase", "frame_relative", "superlative", "limit", "min_area_m2", "max_area_m2", "min_pixels", "max_pixels", "wants_count", "wants_area")) + " FROM pa)"


@query("parse_grounding", f"WITH {_PARSED} SELECT * FROM pg")
def parse_grounding(spark: SparkSession, sf: str) -> DataFrame:
    return language.parse_grounding(requests(spark, sf))


#: CTE vi: the questions' intents and targets.
_INTENT = f"""{_HITS},
cu AS (SELECT * FROM ht x WHERE kind = 'cue' AND NOT (name = 'location' AND EXISTS (SELECT 1 FROM tg y WHERE y.request_id = x.request_id AND y.a <= x.u AND y.u >= x.a))),
cs AS (SELECT request_id, bool_or(name = 'quantity') AS q, bool_or(name = 'count') AS c, bool_or(name = 'composition') AS co, bool_or(name = 'location') AS l FROM cu GROUP BY 1),
ft AS (SELECT request_id, name, min(a) AS a FROM tg GROUP BY 1, 2), nm AS (SELECT request_id, count(*) AS n, string_agg(name, ',' ORDER BY a) AS targets FROM ft GROUP BY 1),
ve AS (SELECT nt.request_id, n, targets, q, c, co, l, coalesce({_REFUSAL}, CASE WHEN coalesce(n, 0) = 0 AND NOT coalesce(co, false) THEN 'no_target' END) AS error FROM nt LEFT JOIN cs USING (request_id) LEFT JOIN nm USING (request_id)),
vi AS MATERIALIZED (SELECT request_id, error, CASE WHEN error IS NOT NULL THEN 'refused' WHEN coalesce(n, 0) = 0 THEN 'composition' WHEN n > 1 THEN 'comparison' WHEN coalesce(c, false) AND NOT coalesce(q, false) THEN 'count'
  WHEN coalesce(l, false) THEN 'location' WHEN coalesce(q, false) OR coalesce(co, false) THEN 'quantity' ELSE 'presence' END AS intent, coalesce(targets, '') AS targets FROM ve)"""


@query("vqa_intent", f"WITH {_INTENT} SELECT * FROM vi")
def vqa_intent(spark: SparkSession, sf: str) -> DataFrame:
    return language.vqa_intent(requests(spark, sf))


@query("html_escape", "SELECT page_id, md5(replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;')) AS escaped_md5 FROM pages")
def html_escape(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "pages").select("page_id", F.md5(language.html_escape(F.col("html"))).alias("escaped_md5"))


_WORDS = "list_distinct(list_filter(regexp_split_to_array(lower(trim({})), '\\s+'), lambda w: w <> ''))"


@query("word_jaccard", f"""WITH p AS (SELECT p_partkey, {_WORDS.format('p_name')} AS a, {_WORDS.format('p_type')} AS b FROM part)
SELECT p_partkey, round(CASE WHEN len(list_distinct(list_concat(a, b))) = 0 THEN 1 ELSE len(list_intersect(a, b))/len(list_distinct(list_concat(a, b)))::DOUBLE END, 6) AS similarity FROM p""")
def word_jaccard(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "part").select("p_partkey", F.round(language.jaccard(F.col("p_name"), F.col("p_type")), 6).alias("similarity"))


@query("humanise", "SELECT o_custkey, CASE WHEN len(l) = 1 THEN l[1] ELSE array_to_string(l[:-2], ', ') || ' and ' || l[-1] END AS listed FROM (SELECT o_custkey, list_sort(list_distinct(list(o_orderpriority))) AS l FROM orders GROUP BY 1)")
def humanise(spark: SparkSession, sf: str) -> DataFrame:
    sets = read(spark, sf, "orders").groupBy("o_custkey").agg(F.sort_array(F.collect_set("o_orderpriority")).alias("l"))
    return sets.select("o_custkey", language.humanise(F.col("l")).alias("listed"))
