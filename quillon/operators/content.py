"""Content metrics that the procedures describe in words; formulas and thresholds are this library's own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillon.functions import text as T
from quillon.operators import ranks

# The evidence and confidence vocabularies.
EVIDENCE = ("confirmed", "observed", "reported", "hypothesis", "conflicting")
CONFIDENCE = ("high", "medium", "low")


def rates(rows: DataFrame, by: list[str], views: str, counts: list[str], per: int = 1000) -> DataFrame:
    """Each count per ``per`` views in the group; null without views."""
    seen = F.sum(views)
    return rows.groupBy(*by).agg(seen.cast("long").alias("views"), *[F.try_divide(F.sum(c).cast("double") * per, seen.cast("double")).alias(f"{c}_rate") for c in counts])


def strata(rows: DataFrame, by: list[str], order: list[Column], names=("top", "middle", "bottom")) -> DataFrame:
    """Thirds of each group in a given order; the first are the larger ones. Groups may hold any number of rows."""
    out = _strata(rows, by, order, len(names))
    return out.withColumn("stratum", F.get(F.array(*map(F.lit, names)), (F.col("_part") - 1).cast("int"))).select(*[c for c in rows.columns if c != "stratum"], "stratum")


def _strata(rows: DataFrame, by: list[str], order: list[Column], n: int) -> DataFrame:
    out = ranks.ranked(rows, by, order, "_place", "_size")
    return out.withColumn("_part", ranks.tile(F.col("_place"), F.col("_size"), n))


def comparable(rows: DataFrame, by: list[str], ts: str, audience: str | None = None, period: str = "month") -> DataFrame:
    """``rows`` with the group in which they may be compared: the same keys, a near period, and an audience of the same power of two."""
    out = rows.withColumn("period", F.date_trunc(period, F.col(ts)).cast("date"))
    size = F.when(F.col(audience) > 0, F.floor(F.log2(F.col(audience).cast("double")))).otherwise(F.lit(-1)) if audience else F.lit(0)
    out = out.withColumn("audience_power", size.cast("long"))
    keys = [*by, "period", "audience_power"]
    n = out.groupBy(*[F.col(k).alias(f"_{i}") for i, k in enumerate(keys)]).agg(F.count(F.lit(1)).alias("peers"))
    on = F.lit(True)
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"_{i}"))
    return out.join(n, on).select(*out.columns, "peers")


def feature_table(rows: DataFrame, key: str, features: dict[str, list[str] | None]) -> DataFrame:
    """(key, feature, value, status) in long form: every publication is coded on the same features.

    ``features``: allowed values of each, or None for free text. A value that isn't there is 'not coded',
    one that isn't allowed is 'unknown value'; nothing is inferred.
    """
    cells = []
    for name, allowed in features.items():
        v = F.trim(F.col(name).cast("string"))
        blank = F.coalesce(v, F.lit("")) == ""
        status = F.when(blank, "not coded").when(v.isin(*allowed) if allowed else F.lit(True), "coded").otherwise("unknown value")
        cells.append(F.struct(F.lit(name).alias("feature"), F.when(~blank, v).alias("value"), status.alias("status")))
    return rows.select(key, F.inline(F.array(*cells)))


def stratified_sample(rows: DataFrame, by: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of every stratum."""
    names = ("top", "middle", "bottom")
    out = _strata(rows, by, order, len(names))
    place = F.col("_place") - ranks.tile_start(F.col("_part"), F.col("_size"), len(names)) + 1
    out = out.withColumns({"stratum": F.get(F.array(*map(F.lit, names)), (F.col("_part") - 1).cast("int")), "place": place.cast("int")})
    return out.filter(F.col("place") <= k).drop("_place", "_size", "_part")


def velocity(events: DataFrame, key: str, ts: str, first: str = "1 hour") -> DataFrame:
    """(key, early, total, first_ts, last_ts, lifetime_seconds): how fast a key's events come and how long they last."""
    start = events.groupBy(key).agg(F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"))
    early = F.count_if(F.col(ts) < F.col("first_ts") + F.expr(f"INTERVAL {first}"))
    seconds = F.unix_micros(F.col("last_ts").cast("timestamp")) - F.unix_micros(F.col("first_ts").cast("timestamp"))
    out = events.join(start, key).groupBy(key, "first_ts", "last_ts").agg(early.alias("early"), F.count(F.lit(1)).alias("total"))
    return out.withColumn("lifetime_seconds", F.floor(seconds / 1_000_000))


def contrast(rows: DataFrame, feature: str, strong: str = "top", weak: str = "bottom") -> DataFrame:
    """How much more often a feature occurs in the strong stratum than in the weak one; an observation, not a cause."""
    of = lambda s: F.count_if(F.col("stratum") == s)
    all_ = rows.agg(of(strong).alias("_s"), of(weak).alias("_w"))
    out = rows.groupBy(feature).agg(of(strong).alias("strong"), of(weak).alias("weak")).join(F.broadcast(all_))  # one row
    share = lambda a, b: F.try_divide(F.col(a).cast("double"), F.col(b).cast("double"))
    return out.select(feature, "strong", "weak", F.try_divide(share("strong", "_s"), share("weak", "_w")).alias("lift"), F.lit("observed").alias("status"))


def shares(rows: DataFrame, category: str) -> DataFrame:
    """Positions of each category and their share of all."""
    per = rows.groupBy(category).agg(F.count(F.lit(1)).alias("n"))
    total = per.agg(F.sum("n").alias("_all"))
    return per.join(F.broadcast(total)).select(category, "n", (F.col("n") / F.col("_all")).alias("share"))  # one row


def check_totals(have: DataFrame, given: DataFrame, key: str) -> DataFrame:
    """(key, n, given, agrees): counted positions against totals that were given; a side without the key is null."""
    return have.select(key, "n").join(given.select(key, F.col("n").alias("given")), key, "full").withColumn("agrees", F.coalesce(F.col("n") == F.col("given"), F.lit(False)))


def gaps(have: DataFrame, want: DataFrame, key: str) -> DataFrame:
    """Keys that only one side has."""
    a, b = have.select(key).distinct(), want.select(key).distinct()
    return a.join(b, key, "left_anti").withColumn("gap", F.lit("not wanted")).unionByName(b.join(a, key, "left_anti").withColumn("gap", F.lit("missing")))


def coverage_matrix(matrix: DataFrame, key: str, attributes: list[str], wanted: DataFrame | None = None) -> DataFrame:
    """(key, filled, missing, complete): how many of the attributes each category has; a wanted one without a row has none."""
    if wanted is not None:
        matrix = wanted.select(key).distinct().join(matrix, key, "left")
    filled = sum((F.when(F.coalesce(F.trim(F.col(a).cast("string")), F.lit("")) != "", 1).otherwise(0) for a in attributes), F.lit(0)).cast("long")
    lost = F.array_compact(F.array(*[F.when(F.coalesce(F.trim(F.col(a).cast("string")), F.lit("")) == "", F.lit(a)) for a in attributes]))
    return matrix.select(key, filled.alias("filled"), lost.alias("missing"), (filled == len(attributes)).alias("complete"))


def top_k(rows: DataFrame, by: list[str], order: list[Column], k: int) -> DataFrame:
    return rows.withColumn("place", F.row_number().over(W.partitionBy(*by).orderBy(*order)).cast("long")).filter(F.col("place") <= k)


def segment_evidence(signals: DataFrame, segment: str, kind: str, least: int = 2) -> DataFrame:
    """A segment stands on ``least`` different kinds of signals, else it is a hypothesis."""
    n = F.countDistinct(kind)
    return signals.groupBy(segment).agg(n.alias("kinds"), F.when(n >= least, "segment").otherwise("hypothesis").alias("status"))


def precedence(claims: DataFrame, claim: list[str], value: str, tier: str, date: str, tie: str) -> DataFrame:
    """The claim of the best tier, the newest of it; ``conflict`` says that sources disagree, and nothing is averaged.

    One aggregate with partial results, so a claim that a third of all rows make isn't brought together.
    """
    newest = F.coalesce(-F.unix_micros(F.col(date).cast("timestamp")), F.lit(2**63 - 1))
    best = F.min_by(F.struct(*[c for c in claims.columns if c not in claim]), F.struct(F.col(tier), newest, F.col(tie)))
    differ = F.coalesce(F.min(value) < F.max(value), F.lit(False))
    out = claims.groupBy(*claim).agg(best.alias("_best"), differ.alias("conflict"))
    return out.select(*[F.col(c) if c in claim else F.col(f"_best.{c}").alias(c) for c in claims.columns], "conflict")


def evidence_status(sources: Column, primary: Column, conflict: Column) -> Column:
    return F.when(conflict, "conflicting").when(primary & (sources >= 2), "confirmed").when(sources >= 2, "observed").when(sources == 1, "reported").otherwise("hypothesis")


def confidence(independent: Column, n: Column) -> Column:
    return F.when((independent >= 3) & (n >= 10), "high").when((independent >= 2) & (n >= 3), "medium").otherwise("low")


def differentiator_class(affects: Column, competitors_share: Column, n: Column) -> Column:
    """Four levels: does it affect the choice, do few competitors have it, is it backed."""
    return F.when(~affects, "no effect").when(n < 2, "unproven").when(competitors_share >= 0.5, "table stakes").otherwise("differentiator")


def advantage_class(claimed: Column, confirmed: Column, competitors_share: Column, affects: Column) -> Column:
    """Six levels, from an unsupported claim to a confirmed difference."""
    return (
        F.when(~claimed & confirmed, "unclaimed strength").when(~confirmed & ~claimed, "absent").when(~confirmed, "unsupported claim")
        .when(~affects, "irrelevant").when(competitors_share >= 0.5, "category norm").otherwise("confirmed advantage")
    )


def themes(rows: DataFrame, corpus: str, theme: str, least: int = 1) -> DataFrame:
    """Theme frequency by corpus, with its rank; below ``least`` documents a theme isn't counted.

    A corpus may hold any number of themes, so no task ranks a whole one: themes are ranked within slices of (corpus,
    frequency), and slices, which are as many as there are different frequencies, give the places before them.
    """
    per = rows.groupBy(corpus, theme).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)
    # the rarest frequencies hold most themes, so a slice is cut by the theme's beginning too
    per = per.withColumn("_slice", F.substring(theme, 1, 2))
    sizes = per.groupBy(corpus, "n", "_slice").agg(F.count(F.lit(1)).alias("_size"))
    before = F.sum("_size").over(W.partitionBy(corpus).orderBy(F.desc("n"), F.asc("_slice")).rowsBetween(W.unboundedPreceding, -1))
    ahead = sizes.withColumn("_ahead", F.coalesce(before, F.lit(0))).drop("_size")
    inside = F.row_number().over(W.partitionBy(corpus, "n", "_slice").orderBy(F.asc(theme)))
    ranked = per.withColumn("_inside", inside).join(ahead, [corpus, "n", "_slice"])
    return ranked.select(corpus, theme, "n", (F.col("_ahead") + F.col("_inside")).cast("long").alias("place"))


def class_mix(rows: DataFrame, by: list[str], kind: str, kinds: list[str]) -> DataFrame:
    return rows.groupBy(*by).pivot(kind, kinds).agg(F.count(F.lit(1))).fillna(0, kinds)


def enough(rows: DataFrame, by: list[str], least: int = 50) -> DataFrame:
    """Sample sizes, with a flag below the least that statements may rest on."""
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).withColumn("limited", F.col("n") < least)


def concept_scores(scores: DataFrame, k: int = 3, criteria: int = 9) -> DataFrame:
    """Concepts by the sum of their scores (0 to 5); one stop criterion at 0 puts a concept out, whatever the sum.

    scores: (concept, criterion, score, is_stop). The first is the main one, up to k - 1 are in reserve.
    """
    per = scores.groupBy("concept").agg(F.sum("score").cast("long").alias("total"), F.coalesce(F.bool_or(F.col("is_stop") & (F.col("score") == 0)), F.lit(False)).alias("stopped"), F.countDistinct("criterion").alias("criteria"))
    per = ranks.ranked(per, ["stopped"], [F.desc("total"), F.asc("concept")])
    role = F.when(F.col("stopped") | (F.col("place") > k), "out").when(F.col("place") == 1, "main").otherwise("reserve")
    return per.withColumn("role", role).withColumn("complete", F.col("criteria") == criteria).drop("place")


def cover_text_fits(tokens: Column, least: int = 2, most: int = 5) -> Column:
    return F.size(tokens).between(least, most)


def changed_one(plan: DataFrame, series: str, order: str, parameters: list[str]) -> DataFrame:
    """A test plan's steps with the number of parameters that changed; a valid step changes one."""
    w = W.partitionBy(series).orderBy(order)
    changed = sum((F.when(F.lag(p).over(w).eqNullSafe(F.col(p)), 0).otherwise(1) for p in parameters), F.lit(0))
    first = F.row_number().over(w) == 1
    return plan.withColumn("changed", F.when(first, 0).otherwise(changed).cast("long")).withColumn("valid", first | (F.col("changed") == 1))


def plan_sizes(plan: DataFrame, series: str, least: int = 8, most: int = 12) -> DataFrame:
    """(series, n, fits): a test plan asks for ``least`` to ``most`` publications."""
    n = F.count(F.lit(1))
    return plan.groupBy(series).agg(n.alias("n"), n.between(least, most).alias("fits"))


def search_gate(answers: DataFrame, categories: list[str], brand: str | None = None, primary: list[str] | None = None, contradictions: DataFrame | None = None, least_known: int = 1) -> DataFrame:
    """Answers (key, ok, answer, sources) with the six reasons for which they don't suffice.

    A failed or empty answer; another brand (its name isn't in the answer); no source on a primary site
    (without a list, no source at all); categories of the shop that the answer lacks; contradictions
    with official documents (rows of ``contradictions`` (key)); fewer than ``least_known`` categories known.
    """
    said = F.lower(F.coalesce("answer", F.lit("")))
    lost = F.array_compact(F.array(*[F.when(~F.contains(said, F.lit(c.lower())), F.lit(c)) for c in categories])) if categories else F.array().cast("array<string>")
    sources = F.coalesce("sources", F.expr("array()").cast("array<struct<url:string>>")) if "sources" not in answers.columns else F.col("sources")
    own = F.filter(sources, lambda x: F.rlike(F.lower(x.url), F.lit("^https?://([^/]*\\.)?(" + "|".join(p.lower().replace(".", "\\.") for p in primary) + ")(/|$)")) if primary else x.url.isNotNull())
    out = answers.withColumns(
        {
            "failed": ~F.coalesce("ok", F.lit(False)) | (F.trim(said) == ""),
            "other_brand": ~F.contains(said, F.lit(brand.lower())) if brand else F.lit(False),
            "no_primary_source": F.coalesce(F.size(own), F.lit(0)) < 1,
            "missing_categories": lost,
            "too_little": F.size(lost) > len(categories) - min(least_known, len(categories)) if categories else F.lit(False),
        }
    )
    if contradictions is None:
        out = out.withColumn("contradicted", F.lit(False))
    else:
        out = out.join(contradictions.select("key").distinct().withColumn("contradicted", F.lit(True)), "key", "left").withColumn("contradicted", F.coalesce("contradicted", F.lit(False)))
    bad = F.col("failed") | F.col("other_brand") | F.col("no_primary_source") | F.col("contradicted") | F.col("too_little")
    return out.withColumn("sufficient", ~bad & (F.size("missing_categories") == 0))


def usage_totals(answers: DataFrame, keys=("prompt_tokens", "completion_tokens", "total_tokens")) -> DataFrame:
    return answers.agg(*[F.coalesce(F.sum(F.col("usage")[k].try_cast("long")), F.lit(0)).alias(k) for k in keys])


def repeated_requests(requests: DataFrame, key: list[str], ts: str, minutes: int = 15) -> DataFrame:
    """Requests with ``reused``: an equal one came within the minutes before. The window slides with each hit."""
    before = F.lag(ts).over(W.partitionBy(*key).orderBy(ts, *[c for c in requests.columns if c not in (*key, ts)][:1]))
    near = F.col(ts) <= before + F.expr(f"INTERVAL {minutes} MINUTES")
    return requests.withColumn("reused", F.coalesce(near, F.lit(False)))


#: One claim with its evidence; every field is text but the date.
CLAIM_CARD = "claim string, status string, source string, source_type string, date date, scope string, quote string, confidence string, note string"


def claim_cards(rows: DataFrame) -> DataFrame:
    """``rows`` as claim cards: the fields of ``CLAIM_CARD`` in their types, null where a row lacks one.

    ``problems`` names what a card may not lack (claim, status, source), and a status or confidence that isn't in the vocabulary.
    """
    fields = [f.split() for f in CLAIM_CARD.split(", ")]
    cards = rows.select(*[(F.col(n) if n in rows.columns else F.lit(None)).try_cast(t).alias(n) for n, t in fields])
    blank = lambda c: F.coalesce(F.trim(F.col(c)), F.lit("")) == ""
    checks = [F.when(blank(c), F.lit(f"no {c}")) for c in ("claim", "status", "source")]
    checks += [F.when(~blank(c) & ~F.col(c).isin(*known), F.lit(f"unknown {c}")) for c, known in (("status", EVIDENCE), ("confidence", CONFIDENCE))]
    return cards.withColumn("problems", F.array_compact(F.array(*checks)))


#: Layers that are never added up: what the platform says, what is seen in the sample, what is assumed.
LAYERS = ("platform", "sample", "assumption")


def layered(rows: DataFrame, kind: str) -> DataFrame:
    """``rows`` with the layer of their kind of source; an unknown kind is an assumption."""
    k = F.col(kind)
    layer = F.when(k.isin("documentation", "rules", "announcement"), LAYERS[0]).when(k.isin("post", "comment", "metric", "review"), LAYERS[1]).otherwise(LAYERS[2])
    return rows.withColumn("layer", layer)


def aligned_claims(claims: DataFrame, signals: DataFrame, competitors: DataFrame, key: str) -> DataFrame:
    """Each claim with the number of customer signals for and against it and of competitors that claim it too.

    signals: (key, agrees); competitors: (key, name). ``gap`` marks a promise that experience contradicts.
    """
    s = signals.groupBy(key).agg(F.count_if("agrees").alias("agree"), F.count_if(~F.col("agrees")).alias("contradict"))
    c = competitors.groupBy(key).agg(F.countDistinct("name").alias("competitors"))
    out = claims.join(s, key, "left").join(c, key, "left").fillna(0, ["agree", "contradict", "competitors"])
    return out.withColumn("gap", F.col("contradict") > F.col("agree"))


def review_profile(reviews: DataFrame, by: list[str], text: str, date: str, themes: DataFrame | None = None, stage: str | None = None) -> DataFrame:
    """Size, period, exact repeats and near copies of each corpus of reviews; themes and stages if they are given.

    Exact repeats differ by case and white space only; near copies have the same words in any order and number.
    ``themes``: (theme, word); a review counts once for each theme of which it holds a word. ``stage``: a
    column with the stage of the way to the purchase. Both come as maps from name to number of reviews.
    """
    low = F.lower(F.trim(F.coalesce(F.col(text), F.lit(""))))
    exact, near = F.sha2(F.regexp_replace(low, r"\s+", " "), 256), F.sha2(F.array_join(F.array_sort(F.array_distinct(T.tokens(T.normalize(text)))), " "), 256)
    n = F.count(F.lit(1))
    out = reviews.groupBy(*by).agg(n.alias("n"), F.min(date).alias("first"), F.max(date).alias("last"), (n - F.countDistinct(exact)).alias("repeats"), (n - F.countDistinct(near)).alias("near_copies"))
    entries = lambda k: F.map_from_entries(F.array_sort(F.collect_list(F.struct(k, "n"))))
    if themes is not None:
        numbered = reviews.select(*by, F.monotonically_increasing_id().alias("_row"), F.array_distinct(T.tokens(T.normalize(text))).alias("_words"))
        numbered = numbered.select(*by, "_row", F.explode("_words").alias("word"))
        hits = numbered.join(themes.select("theme", T.normalize("word").alias("word")).distinct(), "word").select(*by, "_row", "theme").distinct()
        per = hits.groupBy(*by, "theme").agg(n.alias("n")).groupBy(*by).agg(entries("theme").alias("themes"))
        out = out.join(per, by, "left")
    if stage is not None:
        per = reviews.filter(F.col(stage).isNotNull()).groupBy(*by, stage).agg(n.alias("n")).groupBy(*by).agg(entries(stage).alias("stages"))
        out = out.join(per, by, "left")
    return out


def complete_chain(rows: DataFrame, key: str, steps: list[str], step: str) -> DataFrame:
    """(key, missing, complete): which steps of a decision path or segment chain a key lacks."""
    have = rows.groupBy(key).agg(F.collect_set(step).alias("have"))
    lost = F.array_except(F.array(*map(F.lit, steps)), F.col("have"))
    return have.select(key, lost.alias("missing"), (F.size(lost) == 0).alias("complete"))
