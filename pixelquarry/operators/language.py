"""Plain-language requests: normalising, phrase matching, task choice, routing and parsing.

For the choice of a task a request's word n-grams are joined with one lexicon table on the phrase, so
the work grows with the words of the requests and not with requests times phrases. Parsing takes the
first phrase of a kind, one expression each, within the request's row.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelquarry.functions import lexicon

#: Words of the longest phrase.
LONGEST = 5


def normalise(query: Column) -> Column:
    """For vocabulary: lower case, folded units, words and decimals parted by single blanks."""
    text = F.lower(query)
    for old, new in (("²", "2"), ("^2", "2"), ("sq.", "sq ")):
        text = F.replace(text, F.lit(old), F.lit(new))
    text = F.regexp_replace(text, r"[^a-z0-9.]+", " ")
    text = F.regexp_replace(text, r"(?<!\d)\.(?!\d)", " ")
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def normalise_for_tasks(query: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(query), "[^a-z0-9]+", " "))


def lexicon_rows() -> list[tuple[str, str, str, int]]:
    """kind, name, phrase, weight of every phrase."""
    rows = [("target", name, p, 0) for name, ps in lexicon.TARGETS.items() for p in ps]
    rows += [("unsupported", "", p, 0) for p in lexicon.UNSUPPORTED] + [("relation", "", p, 0) for p in lexicon.RELATIONS]
    rows += [("task", name, p, w) for name, ps in lexicon.TASKS.items() for p, w in ps]
    rows += [(kind, name, p, 0) for kind, table in (("cue", lexicon.CUES), ("compass", lexicon.COMPASS), ("frame", lexicon.FRAME)) for name, ps in table.items() for p in ps]
    return rows + [("superlative", name, p, 0) for name, ps in (("largest", lexicon.LARGEST), ("smallest", lexicon.SMALLEST)) for p in ps]


def matches(requests: DataFrame, text: Column, kinds: list[str]) -> DataFrame:
    """request_id, kind, name, phrase, weight, at, until: whole-word phrases and their places.

    ``text`` is normalised; at and until count words from 1, until is the last word.
    """
    spark: SparkSession = requests.sparkSession
    table = spark.createDataFrame([r for r in lexicon_rows() if r[0] in kinds], "kind string, name string, phrase string, weight int")
    words = requests.select("request_id", F.split(text, " ").alias("words"))
    starts = words.select("request_id", "words", F.explode(F.sequence(F.lit(1), F.size("words"))).alias("at"))
    lengths = F.explode(F.sequence(F.lit(1), F.least(F.lit(LONGEST), F.size("words") - F.col("at") + 1)))
    grams = starts.withColumn("n", lengths)
    grams = grams.select("request_id", "at", (F.col("at") + F.col("n") - 1).alias("until"), F.array_join(F.expr("slice(words, at, n)"), " ").alias("phrase"))
    return grams.join(F.broadcast(table), "phrase")


def classify(requests: DataFrame) -> DataFrame:
    """request_id, task, score: the task whose matched phrases weigh most, each counted once.

    Below the least score the task is unknown; a change request that reads as a question (a question
    mark, or a question word first) is change_vqa.
    """
    norm = normalise_for_tasks(F.col("query"))
    hits = matches(requests, norm, ["task"]).select("request_id", "name", "phrase", "weight").distinct()
    scores = hits.groupBy("request_id", "name").agg(F.sum("weight").alias("score"))
    order = F.array_position(F.array(*map(F.lit, lexicon.TIES)), F.col("name"))
    best = scores.groupBy("request_id").agg(F.min_by(F.struct("name", "score"), F.struct(-F.col("score"), order)).alias("b"))
    asks = F.col("query").contains("?") | F.split(norm, " ")[0].isin(*lexicon.QUESTION_WORDS)
    rows = requests.select("request_id", asks.alias("asks")).join(best, "request_id", "left")
    task = F.when(F.coalesce(F.col("b.score"), F.lit(0)) < lexicon.MIN_SCORE, "unknown").when((F.col("b.name") == "change_detection") & F.col("asks"), "change_vqa")
    return rows.select("request_id", task.otherwise(F.col("b.name")).alias("task"), F.coalesce("b.score", F.lit(0)).cast("long").alias("score"))


def route(classified: DataFrame) -> DataFrame:
    """``classified`` (task, n_images, n_optical, n_sar) with routed and source.

    A general description of one radar image becomes a backscatter analysis; a scene-reading task on
    a pair becomes the pair's analysis; an unknown task follows the inputs, or stays unresolved.
    """
    n, optical, sar, task = (F.col(c) for c in ("n_images", "n_optical", "n_sar", "task"))
    fused, compared = "optical_sar_analysis", "change_detection"
    default = F.when((n == 1) & (sar == 1), fused).when(n == 1, "land_cover_analysis").when((n == 2) & (sar == 0), compared)
    default = default.when((n == 2) & (sar == 1) & (optical == 1), fused).when((n == 2) & (sar == 2), compared).otherwise("unknown")
    general, scene = task.isin("vqa", "captioning"), task.isin("vqa", "captioning", "land_cover_analysis", "grounding")
    override = F.when(general & (n == 1) & (sar == 1), fused).when(scene & (n == 2) & (sar == 1) & (optical == 1), fused).when(scene & (n == 2) & (sar != 1), compared)
    routed = F.when(task == "unknown", default).otherwise(F.coalesce(override, task))
    source = F.when(routed == "unknown", "unresolved").when(task == "unknown", "input_default").when(override.isNotNull(), "input_override").otherwise("classifier")
    return classified.withColumns({"routed": routed, "source": source})


def any_of(phrases: Iterable[str]) -> str:
    """An expression for whole-word phrases; at one place the longest counts."""
    return r"\b(" + "|".join(sorted(phrases, key=lambda p: (-len(p), p))) + r")\b"


def first_phrase(text: Column, phrases: Iterable[str]) -> Column:
    """The earliest of ``phrases`` in normalised text, the longest at one place; null if none is."""
    return F.nullif(F.regexp_extract(text, any_of(phrases), 1), F.lit(""))


def _named(phrase: Column, table: dict[str, tuple[str, ...]]) -> Column:
    """The name that a phrase stands for."""
    return F.coalesce(*[F.when(phrase.isin(*phrases), name) for name, phrases in table.items()])


def _all_phrases(table: dict[str, tuple[str, ...]]) -> list[str]:
    return [p for phrases in table.values() for p in phrases]


def target_phrases(text: Column) -> Column:
    """All target phrases of a text in order, none of them inside a longer one.

    No two target phrases overlap but for one inside the other, so that taking the longest at each
    place gives the same as leaving out nested ones.
    """
    return F.regexp_extract_all(text, F.lit(any_of(_all_phrases(lexicon.TARGETS))), 1)


def targets(hits: DataFrame) -> DataFrame:
    """The target phrases that no longer target phrase contains."""
    found = hits.where("kind = 'target'")
    wider = found.select("request_id", F.col("at").alias("a2"), F.col("until").alias("u2"))
    inside = "a2 <= at AND u2 >= until AND u2 - a2 > until - at"
    return found.join(wider, (found["request_id"] == wider["request_id"]) & F.expr(inside), "left_anti")


def _pattern(units: list[str]) -> str:
    return r"(\d+(?:\.\d+)?)\s*(" + "|".join(units) + r")\b"


#: Characters before a measurement in which its comparator stands, and more measurements than fit there.
WINDOW, NEAR = 40, 14


def with_measurements(rows: DataFrame) -> DataFrame:
    """``rows`` (normalised ``text``) with sizes: array of (x, u, k), the numbers, units and bounds that
    the text measures sizes by.

    A measurement counts if a comparator stands in the 40 characters before it; the nearest one
    governs, the longest of those that end at one place; without one the bound is null.
    """
    pattern = _pattern([*lexicon.AREA_UNITS, *lexicon.PIXEL_UNITS])
    # Columns of their own, so that a measurement's step doesn't take the text apart again.
    cut = rows.withColumns({"_found": F.regexp_extract_all("text", F.lit("(" + pattern + ")"), 1), "_between": F.split("text", pattern, -1)})
    found, between = F.col("_found"), F.col("_between")
    number, unit = (lambda m: F.regexp_extract(m, pattern, 1).cast("double")), (lambda m: F.regexp_extract(m, pattern, 2))
    # Read backwards, the nearest phrase comes first.
    backwards = {kind: tuple(p[::-1] for p in phrases) for kind, phrases in lexicon.COMPARATORS.items()}
    nearest = any_of(_all_phrases(backwards))[2:-2]

    def governed(k: Column) -> Column:
        """The bound that stands before measurement ``k``, counted from 0."""
        n = F.least(k, F.lit(NEAR))
        pairs = F.zip_with(F.slice(between, k - n + 1, n), F.slice(found, k - n + 1, n), lambda a, b: F.concat(a, b))
        before = F.right(F.concat(F.array_join(pairs, ""), F.get(between, k)), F.lit(WINDOW))
        return _named(F.regexp_extract(F.reverse(before), nearest, 1), backwards)

    sizes = F.transform(found, lambda m, k: F.struct(number(m).alias("x"), unit(m).alias("u"), governed(k).alias("k")))
    return cut.withColumn("sizes", sizes).drop("_found", "_between")


def size_bounds(sizes: Column) -> dict[str, Column]:
    """min_area_m2, max_area_m2, min_pixels and max_pixels of ``sizes``; the last one of a
    kind wins."""
    factor = F.create_map(*[F.lit(x) for u, f in lexicon.AREA_UNITS.items() for x in (u, float(f))])
    is_pixel = lambda p: p["u"].isin(*lexicon.PIXEL_UNITS)

    def last(kind: str, pixels: bool) -> Column:
        own = F.filter(sizes, lambda p: (p["k"] == kind) & (is_pixel(p) if pixels else ~is_pixel(p)))
        value = F.try_element_at(own, F.lit(-1))
        if not pixels:
            return value["x"] * factor[value["u"]]
        return F.when(F.size(own) > 0, F.greatest(F.lit(1), F.bround(value["x"], 0).cast("int")))

    return {f"{k}_area_m2": last(k, False) for k in ("min", "max")} | {f"{k}_pixels": last(k, True) for k in ("min", "max")}


#: Words that ask for a number of regions, or for an area (fixed values).
COUNT_PHRASES = ("how many", "number of", "count the", "count of", "how much of")
AREA_PHRASES = ("how much", "what area", "total area", "how large", "how big")
#: The longest request, in characters.
LONGEST_QUERY = 1000


def _read(requests: DataFrame) -> DataFrame:
    """request_id, query, text (normalised), and the first relation and object without a detector in it."""
    rows = requests.select("request_id", F.col("query"), normalise(F.coalesce("query", F.lit(""))).alias("text"))
    found = {"relation": first_phrase(F.col("text"), lexicon.RELATIONS), "unsupported": first_phrase(F.col("text"), lexicon.UNSUPPORTED)}
    return rows.withColumns(found)


def _refusal() -> Column:
    """Why a request can't be read at all: empty, too long, or about what nothing here measures."""
    error = F.when(F.coalesce(F.trim("query"), F.lit("")) == "", "empty").when(F.length("query") > LONGEST_QUERY, "too_long")
    return error.when(F.col("relation").isNotNull(), "spatial_relation").when(F.col("unsupported").isNotNull(), "unsupported_object")


def parse_grounding(requests: DataFrame) -> DataFrame:
    """request_id, error, refused, target, target_phrase, sector, sector_phrase, frame_relative,
    superlative, limit, the size bounds, wants_count and wants_area.

    Refused, in this order: an empty or too long request, a spatial relation, an object without a
    detector (``refused`` names the phrase), no target, more than one class. The longest target
    phrase is the target's, and is passed over where a sector is looked for; a compass word governs
    over a frame word; both superlatives at once cancel out. Only the error is set of what is refused.
    A row's words decide alone: there is no join.
    """
    rows = with_measurements(_read(requests).withColumn("phrases", target_phrases(F.col("text"))))
    longest = F.array_max(F.transform("phrases", lambda p, k: F.struct(F.length(p).alias("n"), (-k).alias("k"), p.alias("p"))))["p"]
    classes = F.array_distinct(F.transform("phrases", lambda p: _named(p, lexicon.TARGETS)))
    rows = rows.withColumns({"phrase": longest, "classes": classes})
    blank = F.coalesce(F.replace("text", F.col("phrase"), F.repeat(F.lit(" "), F.length("phrase"))), F.col("text"))
    compass, frame = first_phrase(blank, _all_phrases(lexicon.COMPASS)), first_phrase(blank, _all_phrases(lexicon.FRAME))
    large, small = (first_phrase(F.col("text"), words).isNotNull() for words in (lexicon.LARGEST, lexicon.SMALLEST))
    superlative = F.when(large & ~small, "largest").when(small & ~large, "smallest")
    numbers = {w: i + 1 for i, w in enumerate(lexicon.NUMBER_WORDS)}
    before = any_of([r"\d+", *numbers])[2:-2] + r"\s+" + any_of([*lexicon.LARGEST, *lexicon.SMALLEST])[2:]
    count = F.regexp_extract("text", r"\b" + before, 1)
    as_number = F.coalesce(*[F.when(F.col("count") == w, n) for w, n in numbers.items()], F.col("count").try_cast("int"))
    error = _refusal().when(F.size("classes") == 0, "no_target").when(F.size("classes") > 1, "several_targets")
    rows = rows.withColumns({"error": error, "compass": compass, "frame": frame, "superlative": superlative, "count": count})
    ok = lambda c: F.when(F.col("error").isNull(), c)
    said = lambda phrases: F.greatest(*[F.contains("text", F.lit(p)) for p in phrases])
    return rows.select(
        "request_id",
        "error",
        F.when(F.col("error") == "spatial_relation", F.col("relation")).when(F.col("error") == "unsupported_object", F.col("unsupported")).alias("refused"),
        ok(F.col("classes")[0]).alias("target"),
        ok(F.col("phrase")).alias("target_phrase"),
        ok(F.coalesce(_named(F.col("compass"), lexicon.COMPASS), _named(F.col("frame"), lexicon.FRAME))).alias("sector"),
        ok(F.coalesce("compass", "frame")).alias("sector_phrase"),
        ok(F.col("compass").isNull() & F.col("frame").isNotNull()).alias("frame_relative"),
        ok(F.col("superlative")).alias("superlative"),
        ok(F.when(F.col("superlative").isNotNull(), F.greatest(F.lit(1), F.coalesce(as_number, F.lit(1))))).alias("limit"),
        *[ok(c).alias(n) for n, c in size_bounds(F.col("sizes")).items()],
        ok(said(COUNT_PHRASES)).alias("wants_count"),
        ok(said(AREA_PHRASES)).alias("wants_area"),
    )


def vqa_intent(requests: DataFrame) -> DataFrame:
    """request_id, error, intent, targets (classes in order of first mention).

    A request that is empty, too long, about a relation or an object without a detector has that
    error and the intent ``refused``; so has one that names no class and doesn't ask for a whole
    description. A location word inside a target phrase names no place.
    """
    rows = _read(requests)
    named = F.array_distinct(F.transform(target_phrases(F.col("text")), lambda p: _named(p, lexicon.TARGETS)))
    rows = rows.withColumns({"targets": named, "blank": F.regexp_replace("text", any_of(_all_phrases(lexicon.TARGETS)), "  ")})
    has = lambda cue, text="text": first_phrase(F.col(text), lexicon.CUES[cue]).isNotNull()
    n = F.size("targets")
    error = _refusal().when((n == 0) & ~has("composition"), "no_target")
    intent = F.when(F.col("error").isNotNull(), "refused").when(n == 0, "composition").when(n > 1, "comparison")
    intent = intent.when(has("count") & ~has("quantity"), "count").when(has("location", "blank"), "location")
    intent = intent.when(has("quantity") | has("composition"), "quantity").otherwise("presence")
    return rows.withColumn("error", error).select("request_id", "error", intent.alias("intent"), F.array_join("targets", ",").alias("targets"))


def humanise(items: Column) -> Column:
    """a, b and c."""
    n = F.size(items)
    head = F.array_join(F.slice(items, F.lit(1), F.greatest(n - 1, F.lit(0))), ", ")
    return F.when(n == 0, "").when(n == 1, items[0]).otherwise(F.concat(head, F.lit(" and "), F.element_at(items, -1)))


def html_escape(text: Column) -> Column:
    for old, new in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def jaccard(a: Column, b: Column) -> Column:
    """Share of common words of two texts; equal texts without words are alike."""
    words = [F.array_distinct(F.filter(F.split(F.lower(F.trim(x)), r"\s+"), lambda w: w != "")) for x in (a, b)]
    union = F.size(F.array_union(*words))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(*words)) / union)
