"""What is said: a corpus of words, keywords of units, tone, the spread of words along ties, topics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinweave import shiftrules, storage
from kinweave.functions import text as words
from kinweave.model import Dataset

#: Fixed values of the keyword rule.
LEAST_TOKENS, LEAST_COUNT, TOP, OVERALL = 20, 2, 30, 30
#: Fixed values of the language hint, of tone and of the spread test.
LEAST_LETTERS, FOREIGN_SHARE, POSITIVE, NEGATIVE, CEILING, LEAST_ADOPTERS, AUTO_TERMS, EARLY_SHARE = 4, 0.3, 0.05, -0.05, 0.85, 5, 8, 0.1


def likely_non_english(text: Column) -> Column:
    """True for at least four letters of which more than 30 % are outside A-Z; null counts as no text."""
    letters = F.length(F.regexp_replace(text, r"\P{L}+", ""))
    latin = F.length(F.regexp_replace(text, "[^A-Za-z]+", ""))
    return F.coalesce((letters >= LEAST_LETTERS) & ((letters - latin) > FOREIGN_SHARE * letters), F.lit(False))


def corpus(ds: Dataset, stop: list[str] | None = None, keep_names: bool = False, exclude_bots: bool = True) -> DataFrame:
    """(event_id, actor, context, source, t, quoted, signature, tokens) of messages with text: cleaned, without stop words and the names of people in the data."""
    stop = stop if stop is not None else [*words.english_stopwords(), *words.CALENDAR]
    messages = ds.events.where("type = 'message' AND text IS NOT NULL AND text <> ''").withColumn("clean", words.cleaned("text"))
    if exclude_bots:
        messages = messages.join(ds.nodes.where("is_bot").select(F.col("node_id").alias("actor")), "actor", "left_anti")
    found = messages.select("event_id", "actor", "context", "source", "t", "clean.quoted", "clean.signature", words.tokens(F.col("clean.text"), stop).alias("tokens"))
    if keep_names:
        return found
    names = words.name_words(ds.nodes)
    bare = found.select("event_id", F.posexplode("tokens").alias("pos", "word")).join(names, "word", "left_anti")
    kept = bare.groupBy("event_id").agg(F.array_sort(F.collect_list(F.struct("pos", "word"))).alias("kept"))
    return found.drop("tokens").join(kept, "event_id", "left").withColumn("tokens", F.coalesce(F.col("kept.word"), F.array().cast("array<string>"))).drop("kept")


def unit(ds: Dataset, docs: DataFrame, by: str, attr: str | None = None, window: str = "week") -> DataFrame:
    """The corpus with each message's unit: all, node, context, source, visibility, group (an attribute of the actor) or window; null where it has none."""
    if by == "node":
        return docs.withColumn("unit", F.col("actor").cast("string"))
    if by == "context":
        return docs.withColumn("unit", F.col("context").cast("string"))
    if by == "source":
        return docs.join(F.broadcast(ds.sources.select(F.col("source_id").alias("source"), F.col("format").alias("unit"))), "source", "left")
    if by == "visibility":
        known = ds.contexts.select(F.col("context_id").alias("context"), F.col("visibility").alias("unit"))
        return docs.join(known, "context", "left").withColumn("unit", F.coalesce("unit", F.lit("unknown")))
    if by == "group":
        value = F.col("attrs")[attr]
        return docs.join(ds.nodes.select(F.col("node_id").alias("actor"), F.when(value != "", value).alias("unit")), "actor", "left")
    if by == "window":
        return docs.withColumn("unit", F.date_format(F.date_trunc(window, F.col("t")), "yyyy-MM" if window == "month" else "yyyy-MM-dd"))
    return docs.withColumn("unit", F.lit("all"))


def keywords(texts: DataFrame, top: int = TOP) -> DataFrame:
    """(unit, term, n, score, place): TF-IDF of words of two letters and more for texts (unit, text); null units and texts don't count."""
    found = texts.where("unit IS NOT NULL AND text IS NOT NULL").select("unit", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}{2,}"), F.lit(0))).alias("term"))
    return ranked_terms(found, top)


def keywords_of(docs: DataFrame, top: int = 10) -> DataFrame:
    """(unit, term, n, score, place) of a corpus with units (unit, tokens)."""
    return ranked_terms(docs.where("unit IS NOT NULL").select("unit", F.explode("tokens").alias("term")), top)


def ranked_terms(found: DataFrame, top: int) -> DataFrame:
    """TF-IDF of (unit, term) rows. Words are counted once, to a table, from which totals, units and df follow; texts are read a single time."""
    counts = storage.materialize(found.groupBy("unit", "term").agg(F.count("*").alias("n")), "counts")
    totals = counts.groupBy("unit").agg(F.sum("n").alias("total")).where(F.col("total") >= LEAST_TOKENS)
    held = counts.join(totals, "unit")
    spread = held.groupBy("term").agg(F.count("*").alias("df"))
    units = totals.agg(F.count("*").alias("units"))
    score = F.col("n") / F.col("total") * (F.log((1 + F.col("units")) / (1 + F.col("df"))) + 1)
    scored = held.where(F.col("n") >= LEAST_COUNT).join(spread, "term").join(F.broadcast(units)).select("unit", "term", "n", score.alias("score"))
    place = F.row_number().over(Window.partitionBy("unit").orderBy(F.desc(F.round("score", 9)), F.desc("n"), "term"))
    return scored.withColumn("place", place).where(F.col("place") <= top)


def overall_terms(docs: DataFrame, top: int = OVERALL) -> DataFrame:
    """(term, n, messages): the words used most, and in how many messages."""
    return docs.select("event_id", F.explode("tokens").alias("term")).groupBy("term", "event_id").agg(F.count("*").alias("n")).groupBy("term").agg(F.sum("n").alias("n"), F.count("*").alias("messages")).orderBy(F.desc("n"), "term").limit(top)


# ---- tone ----

#: Fixed values of the rule-based scorer (Hutto and Gilbert 2014): boost of a degree word, of capitals, of marks, weight of a negation, normalisation.
BOOST, CAPITALS, EXCLAIM, NEGATED, SQUARED = 0.293, 0.733, 0.292, -0.74, 15.0
NEGATIONS = "not no never none nothing nowhere neither nor cannot without hardly rarely seldom aint arent cant couldnt didnt doesnt dont hadnt hasnt havent isnt mustnt neednt shouldnt wasnt werent wont wouldnt".split()
DEGREES = {1: "absolutely amazingly awfully completely considerably decidedly deeply enormously entirely especially exceptionally extremely fabulously fully greatly highly hugely incredibly intensely majorly more most particularly purely quite really remarkably so substantially thoroughly totally tremendously unbelievably unusually utterly very".split(), -1: "almost barely hardly kinda less little marginally occasionally partly scarcely slightly somewhat sorta".split()}


def tone(texts: DataFrame, lexicon: DataFrame, id_col: str = "event_id", text_col: str = "text", most_chars: int = 5000) -> DataFrame:
    """(id, compound, pos, neg, neu) by a lexicon (word, valence) with rules for negation, degree words, capitals and exclamation marks.

    The lexicon is a parameter, a table of a few thousand words that meets words by a join. Texts beyond ``most_chars`` are scored by that much of them, as the method has it."""
    body = F.substring(text_col, 1, most_chars)
    raw = texts.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), body.alias("body")).withColumn("ws", F.filter(F.split("body", r"\s+"), lambda w: w != ""))
    bare = lambda w: F.lower(F.regexp_replace(w, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", ""))
    raw = raw.withColumn("words", F.transform("ws", bare)).withColumn("mixed", F.exists("ws", lambda w: w.rlike(r"\p{Ll}")))
    raw = raw.withColumn("marks", F.least(F.size(F.regexp_extract_all("body", F.lit("!"), F.lit(0))), F.lit(4)))
    at = raw.select("id", F.posexplode("words").alias("pos", "word"), "ws", "words", "mixed").join(lexicon.select("word", F.col("valence").cast("double").alias("valence")), "word")
    before = F.expr("slice(words, greatest(pos - 2, 1), least(pos, 3))")
    sign = F.signum("valence")
    listed = lambda ws: F.array(*[F.lit(w) for w in ws])
    steps = F.aggregate(F.transform(F.reverse(before), lambda w, i: F.when(F.array_contains(listed(DEGREES[1]), w), BOOST).when(F.array_contains(listed(DEGREES[-1]), w), -BOOST).otherwise(0.0) * (1 - 0.05 * i)), F.lit(0.0), lambda a, x: a + x)
    loud = F.col("mixed") & F.expr("ws[pos]").rlike(r"^[^\p{Ll}]*\p{Lu}[^\p{Ll}]*\p{Lu}[^\p{Ll}]*$")
    value = F.col("valence") + sign * (steps + F.when(loud, CAPITALS).otherwise(0.0))
    negated = F.exists(before, lambda w: F.array_contains(listed(NEGATIONS), F.regexp_replace(w, "['’]", "")))
    scored = at.select("id", (value * F.when(negated, NEGATED).otherwise(1.0)).alias("v"))
    sums = scored.groupBy("id").agg(F.sum("v").alias("sum"), F.sum(F.when(F.col("v") > 0, F.col("v") + 1).otherwise(0.0)).alias("up"), F.sum(F.when(F.col("v") < 0, F.col("v") - 1).otherwise(0.0)).alias("down"), F.count_if(F.col("v") != 0).alias("hits"))
    whole = raw.select("id", F.size(F.filter("words", lambda w: w != "")).alias("words"), "marks").join(sums, "id", "left").fillna(0, ["sum", "up", "down", "hits"])
    more = F.col("marks") * EXCLAIM
    total = F.col("sum") + F.signum("sum") * more
    up, down = F.col("up") + F.when(F.col("up") > F.abs("down"), more).otherwise(0.0), F.abs(F.col("down") - F.when(F.col("up") < F.abs("down"), more).otherwise(0.0))
    rest = F.greatest(F.col("words") - F.col("hits"), F.lit(0))
    all_ = up + down + rest
    part = lambda x: F.when(all_ > 0, x / all_).otherwise(0.0)
    return whole.select(F.col("id").alias(id_col), F.when(F.col("hits") > 0, total / F.sqrt(total * total + SQUARED)).otherwise(0.0).alias("compound"), part(up).alias("pos"), part(down).alias("neg"), part(rest).alias("neu"))


def tone_by_unit(scores: DataFrame, least: int = 1) -> DataFrame:
    """(unit, n, mean, sd, se, pos, neg, neu, pos_share, neg_share) of scores with a unit."""
    sums = scores.where("unit IS NOT NULL").groupBy("unit").agg(
        F.count("*").alias("n"), F.avg("compound").alias("mean"), F.stddev_samp("compound").alias("sd"), F.avg("pos").alias("pos"), F.avg("neg").alias("neg"), F.avg("neu").alias("neu"),
        F.avg((F.col("compound") >= POSITIVE).cast("double")).alias("pos_share"), F.avg((F.col("compound") <= NEGATIVE).cast("double")).alias("neg_share"),
    ).where(F.col("n") >= least)
    return sums.withColumn("se", F.col("sd") / F.sqrt("n"))


# ---- spread of words ----


def first_uses(docs: DataFrame) -> DataFrame:
    """(term, node, t): each person's first dated use of a word; docs (actor, t, tokens)."""
    return docs.where("t IS NOT NULL AND actor IS NOT NULL").select(F.col("actor").alias("node"), "t", F.explode(F.array_distinct("tokens")).alias("term")).groupBy("term", "node").agg(F.min("t").alias("t"))


def new_terms(uses: DataFrame, docs: DataFrame, common: list[str], top: int = AUTO_TERMS, least: int = LEAST_ADOPTERS) -> DataFrame:
    """(term): words that nobody used in the first tenth of the period, no everyday ones, with the most people who took them up."""
    span = docs.where("t IS NOT NULL").agg(F.min("t").alias("a"), F.max("t").alias("b"))
    per = uses.groupBy("term").agg(F.count("*").alias("people"), F.min("t").alias("first")).where(F.col("people") >= least).join(F.broadcast(span))
    late = F.timestamp_diff("MICROSECOND", F.col("a"), F.col("first")) >= EARLY_SHARE * F.timestamp_diff("MICROSECOND", F.col("a"), F.col("b"))
    fresh = per.where(late & ~F.col("term").rlike(r"^\d"))
    if common:
        fresh = fresh.where(~words.is_common(F.col("term"), common))
    return fresh.orderBy(F.desc("people"), "term").limit(top).select("term")


def exposure(uses: DataFrame, pairs: DataFrame, window_seconds: float | None = None, keys: tuple[str, ...] = ("term",)) -> DataFrame:
    """(keys, node, t, first, parent): for each adopter the contact who used the word most recently before, if any; pairs (u, v) both ways; ``first`` marks those at the earliest time."""
    start = uses.groupBy(*keys).agg(F.min("t").alias("start"))
    other = uses.select(*keys, F.col("node").alias("v"), F.col("t").alias("before"))
    met = uses.join(pairs.withColumnRenamed("u", "node"), "node").join(other, [*keys, "v"]).where("before < t")
    if window_seconds is not None:
        met = met.where(F.timestamp_diff("MICROSECOND", F.col("before"), F.col("t")) <= window_seconds * 1e6)
    parents = met.groupBy(*keys, "node").agg(F.max(F.struct("before", (-F.col("v")).alias("order"), "v")).alias("p"))
    return uses.join(start, list(keys)).join(parents, [*keys, "node"], "left").select(*keys, "node", "t", (F.col("t") == F.col("start")).alias("first"), F.when(F.col("t") != F.col("start"), F.col("p.v")).alias("parent"))


def diffusion(uses: DataFrame, pairs: DataFrame, reps: int = 200, window_seconds: float | None = None, seed: int = 1) -> DataFrame:
    """(term, adopters, eligible, exposed, share, mean, sd, z, p, p_adjusted, ceiling, roots, depth, largest): whether words spread along ties.

    The null permutes adoption times among a word's adopters. A replicate is a grouping column: the adopter at place k of a hash order gets the k-th time.
    uses: (term, node, t) of the words to test, people in the network only."""
    uses = storage.materialize(uses, "uses")
    seen = storage.materialize(exposure(uses, pairs, window_seconds), "exposure")
    share = lambda t, keys: t.groupBy(*keys).agg(F.count("*").alias("adopters"), F.count_if(~F.col("first")).alias("eligible"), F.count("parent").alias("exposed")).withColumn("share", F.when(F.col("eligible") > 0, F.col("exposed") / F.col("eligible")))
    spread = uses.withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(reps))))
    place = F.row_number().over(Window.partitionBy("term", "rep").orderBy(F.xxhash64("node", "rep", "term", F.lit(seed)), "node"))
    people = spread.withColumn("place", place).select("term", "rep", "node", "place")
    times = uses.withColumn("place", F.row_number().over(Window.partitionBy("term").orderBy("t", "node"))).select("term", "place", "t")
    drawn = people.join(times, ["term", "place"]).select("term", "rep", "node", "t")
    sims = storage.materialize(share(exposure(drawn, pairs, window_seconds, ("term", "rep")), ["term", "rep"]).select("term", F.col("share").alias("sim")), "shuffles")
    observed = share(seen, ["term"])
    met = observed.join(sims, "term").groupBy("term").agg(F.avg("sim").alias("mean"), F.stddev_samp("sim").alias("sd"), F.count_if(F.col("sim") >= F.col("share") - 1e-12).alias("above"), F.count("sim").alias("k"))
    rows = observed.join(met, "term", "left").join(cascades(seen), "term", "left")
    rows = rows.withColumn("z", F.when(F.col("sd") > 0, (F.col("share") - F.col("mean")) / F.col("sd"))).withColumn("p", F.when(F.col("share").isNotNull() & (F.col("k") > 0), (F.col("above") + 1) / (F.col("k") + 1)))
    # the words tested are few: Holm's steps over all of them
    order = Window.orderBy("p", "term")
    tested = rows.where("p IS NOT NULL").withColumn("i", F.row_number().over(order)).withColumn("m", F.count("*").over(Window.partitionBy(F.lit(1))))
    stepped = tested.withColumn("p_adjusted", F.max(F.least(F.lit(1.0), (F.col("m") - F.col("i") + 1) * F.col("p"))).over(order.rowsBetween(Window.unboundedPreceding, 0))).select("term", "p_adjusted")
    return rows.join(stepped, "term", "left").select("term", "adopters", "eligible", "exposed", "share", "mean", "sd", "z", "p", "p_adjusted", (F.col("mean") >= CEILING).alias("ceiling"), "roots", "depth", "largest")


def cascades(seen: DataFrame) -> DataFrame:
    """(term, roots, depth, largest) of the forest of parents; a parent is always earlier, so steps to a root double each round."""
    spark = seen.sparkSession
    up, path = storage.stored(seen.select("term", "node", F.coalesce("parent", "node").alias("top"), F.when(F.col("parent").isNull(), 0).otherwise(1).alias("depth")), "cascade")
    while True:
        higher = up.select("term", F.col("node").alias("top"), F.col("top").alias("next"), F.col("depth").alias("more"))
        after, after_path = storage.stored(up.join(higher, ["term", "top"]).select("term", "node", F.col("next").alias("top"), (F.col("depth") + F.col("more")).alias("depth"), (F.col("more") > 0).alias("moved")), "cascade")
        storage.discard(spark, path)
        done = after.where("moved").isEmpty()
        up, path = after.drop("moved"), after_path
        if done:
            break
    size = up.groupBy("term", "top").agg(F.count("*").alias("size"), F.max("depth").alias("depth"))
    return size.groupBy("term").agg(F.count("*").alias("roots"), F.max("depth").alias("depth"), F.max("size").alias("largest"))


# ---- topics ----


def topics(docs: DataFrame, k: int = 10, seed: int = 1, rounds: int = 30, least_df: int | None = None, most_df: float = 0.25, most_terms: int = 5000, least_tokens: int = 3, top: int = 10, relevance: float = 0.6):
    """(terms (topic, place, term, weight), shares (event_id, topic, share)): latent Dirichlet topics of a corpus.

    The estimator is Spark's online variational one, not a collapsed Gibbs sampler, with the same priors (0.1 and 0.01) and the same choice of vocabulary; terms are
    ordered by relevance, a mean of log weight and log lift. Topics depend on seed and estimator; compare invariants, not labels."""
    from pyspark.ml.clustering import LDA
    from pyspark.ml.feature import CountVectorizer
    from pyspark.ml.functions import vector_to_array

    n = docs.count()
    least = least_df if least_df is not None else max(2, int(n * 0.0005))
    vectors = CountVectorizer(inputCol="tokens", outputCol="features", vocabSize=most_terms, minDF=float(least), maxDF=float(max(1, int(most_df * n)))).fit(docs)
    held = vectors.transform(docs).where(F.aggregate(vector_to_array("features"), F.lit(0.0), lambda a, x: a + x) >= least_tokens)
    model = LDA(k=k, seed=seed, maxIter=rounds, optimizer="online", docConcentration=[0.1] * k, topicConcentration=0.01, featuresCol="features").fit(held)
    spark = docs.sparkSession
    matrix = model.topicsMatrix().toArray()  # vocabulary times topics, at most most_terms rows
    weight = matrix / matrix.sum(0, keepdims=True)
    overall = matrix.sum(1) / matrix.sum()
    import numpy as np

    score = relevance * np.log(weight) + (1 - relevance) * np.log(weight / overall[:, None])
    rows = [(t, i + 1, vectors.vocabulary[v], float(weight[v, t])) for t in range(k) for i, v in enumerate(np.argsort(-score[:, t], kind="stable")[:top])]
    shares = model.transform(held).select("event_id", F.posexplode(vector_to_array("topicDistribution")).alias("topic", "share"))
    return spark.createDataFrame(rows, "topic int, place int, term string, weight double"), shares


# ---- samples and codes ----


def thinned(table: DataFrame, most: int, order: str = "event_id") -> DataFrame:
    """At most about ``most`` rows, evenly by an order: every k-th one."""
    from kinweave.functions import ranked

    n = table.count()
    if n <= most:
        return table
    stride = n / most
    numbered = ranked.numbered(table, F.col(order).cast("double"), "_n", (order,))
    return numbered.where(F.floor((F.col("_n") - 1) / stride) != F.floor((F.col("_n") - 2) / stride)).drop("_n")


def stratified(table: DataFrame, stratum: str, size: int, seed: int = 1, id_col: str = "event_id") -> DataFrame:
    """A sample of ``size`` rows with each stratum in proportion (largest remainders, one at least while there is room), in a hash order fixed by the seed."""
    sizes = table.groupBy(F.coalesce(F.col(stratum).cast("string"), F.lit("")).alias("_s")).agg(F.count("*").alias("_n"))
    counts = {r["_s"]: r["_n"] for r in sizes.collect()}  # a row for each stratum
    total = sum(counts.values())
    size = min(size, total)
    exact = {s: size * n / total for s, n in counts.items()} if total else {}
    least = 1 if size >= len(counts) else 0
    quota = {s: min(counts[s], max(least, int(x))) for s, x in exact.items()}
    by_rest = sorted(exact, key=lambda s: (int(exact[s]) - exact[s], s))
    while sum(quota.values()) < size:
        for s in by_rest:
            if sum(quota.values()) < size and quota[s] < counts[s]:
                quota[s] += 1
    while sum(quota.values()) > size:
        quota[next((s for s in sorted(quota) if quota[s] > 1), min(s for s in quota if quota[s]))] -= 1
    quotas = table.sparkSession.createDataFrame(list(quota.items()) or [("", 0)], "_s string, _q bigint")
    place = F.row_number().over(Window.partitionBy("_s").orderBy(F.xxhash64(id_col, F.lit(seed)), id_col))
    marked = table.withColumn("_s", F.coalesce(F.col(stratum).cast("string"), F.lit(""))).withColumn("_place", place)
    return marked.join(F.broadcast(quotas), "_s").where("_place <= _q").drop("_s", "_q", "_place")


def krippendorff(codes: DataFrame) -> DataFrame:
    """One row: items with two codes at least, and Krippendorff's alpha for nominal codes (item, coder, code)."""
    held = codes.where("code IS NOT NULL")
    paired = held.join(held.groupBy("item").agg(F.count("*").alias("m")).where("m > 1"), "item")
    per = paired.groupBy("item", "m", "code").agg(F.count("*").alias("n"))
    agree = per.agg(F.sum(F.col("n") * (F.col("n") - 1) / (F.col("m") - 1)).alias("same"))
    totals = per.groupBy("code").agg(F.sum("n").cast("double").alias("n")).agg(F.sum("n").alias("all"), F.sum(F.col("n") * (F.col("n") - 1)).alias("chance"))
    items = paired.agg(F.count_distinct("item").alias("items"))
    row = agree.join(F.broadcast(totals)).join(F.broadcast(items))
    observed = 1 - F.col("same") / F.col("all")
    expected = 1 - F.col("chance") / (F.col("all") * (F.col("all") - 1))
    return row.select("items", F.when(expected > 0, 1 - observed / expected).otherwise(F.when(F.col("items") > 0, 1.0)).alias("alpha"))


def agreement_by_code(codes: DataFrame, one: str, other: str) -> DataFrame:
    """(code, both, either, agreement) of two coders that may give several codes to an item: codes (item, coder, code)."""
    a = codes.where(F.col("coder") == one).select("item", "code").distinct().withColumn("a", F.lit(1))
    b = codes.where(F.col("coder") == other).select("item", "code").distinct().withColumn("b", F.lit(1))
    met = a.join(b, ["item", "code"], "full").groupBy("code").agg(F.count(F.col("a") + F.col("b")).alias("both"), F.count("*").alias("either"))
    return met.withColumn("agreement", F.col("both") / F.col("either"))


def adjusted(table: DataFrame, column: str = "p") -> list[float]:
    """Holm's adjustment of a few p-values, in the table's order."""
    return shiftrules.holm([r[column] for r in table.select(column).collect()])
