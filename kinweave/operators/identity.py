"""Who is who: proposals of nodes that may be one person, merging of nodes and of datasets, profile tables joined to people."""

from __future__ import annotations

from dataclasses import replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinweave import storage
from kinweave.functions import text as words
from kinweave.model import Dataset
from kinweave.operators import components
from kinweave.sources import base

#: Sizes of buckets that name one person at most, fields that hold chosen names, namespaces whose ids mean nothing elsewhere.
MOST_IN_BUCKET, HANDLES, LOCAL = 50, ["handle", "username", "acct", "screen_name"], ["net", "csv", "nc", "survey", "row", "canvas", "tabular", "gml", "pajek", "whatsapp_name"]
RANK = {"high": 3, "medium": 2, "low": 1}


def _namespace(key: str) -> Column:
    return F.when(F.col(key).contains(":"), F.substring_index(key, ":", 1)).otherwise("")


def _people(nodes: DataFrame) -> DataFrame:
    """(node, key, label, is_bot, ns, alter, ids, emails, phones, names) of nodes."""
    ids = F.coalesce("platform_ids", F.create_map().cast("map<string, string>")) if "platform_ids" in nodes.columns else F.create_map().cast("map<string, string>")
    held = nodes.withColumn("ids", ids).withColumn("attrs", F.coalesce("attrs", F.create_map().cast("map<string, string>")))
    of = lambda pattern: F.map_values(F.map_filter("ids", lambda k, _: k.rlike(pattern)))
    mails = F.array_compact(F.concat(F.array(F.when(F.col("key").startswith("email:"), F.substring("key", 7, 500)), F.col("attrs")["email"]), of("(?i)email")))
    mails = F.array_distinct(F.filter(F.transform(mails, lambda x: F.lower(F.trim(F.regexp_replace(x, "(?i)^mailto:", "")))), lambda x: x.rlike(r"^[^\s@<>]+@[^\s@<>]+\.[^\s@<>]+$")))
    phones = F.array_compact(F.concat(F.array(F.col("attrs")["phone"]), of("(?i)phone|tel|msisdn")))
    phones = F.array_distinct(F.array_compact(F.transform(F.filter(phones, lambda x: ~x.contains("@")), words.phone)))
    named = F.array_compact(F.array("label", *[F.col("attrs")[k] for k in ("real_name", "full_name", "name", "display_name")]))
    names = F.array_distinct(F.filter(F.transform(named, lambda x: F.array_join(words.name_tokens(x), " ")), lambda x: x != ""))
    return held.select(F.col("node_id").alias("node"), "key", "label", F.coalesce("is_bot", F.lit(False)).alias("is_bot"), _namespace("key").alias("ns"), F.coalesce(F.col("attrs")["kind"] == "alter", F.lit(False)).alias("alter"), "ids", mails.alias("emails"), phones.alias("phones"), names.alias("names"))


def _met(rows: DataFrame, most: int) -> DataFrame:
    """Pairs of rows (value, node, ...) of buckets of two to ``most`` nodes; a bucket's pairs are bounded by that."""
    sizes = rows.groupBy("value").agg(F.count_distinct("node").alias("size")).where(F.col("size").between(2, most))
    held = rows.join(sizes, "value")
    rest = [c for c in rows.columns if c != "value"]
    one, other = held.select("value", *[F.col(c).alias(f"{c}_a") for c in rest]), held.select("value", *[F.col(c).alias(f"{c}_b") for c in rest])
    return one.join(other, "value").where("node_a < node_b")


def suggestions(nodes: DataFrame, most: int = MOST_IN_BUCKET) -> DataFrame:
    """(a, b, key_a, key_b, confidence, evidence): proposals that are never applied by themselves, surest first. A bot and a person are never proposed."""
    people = storage.materialize(_people(nodes), "people")
    common = ["node", "is_bot", "ns", "alter"]
    exploded = lambda c: people.select(*common, F.explode(c).alias("value"))
    pair = lambda t, confidence, evidence: t.where("is_bot_a = is_bot_b").select(F.col("node_a").alias("a"), F.col("node_b").alias("b"), confidence.alias("confidence"), evidence.alias("evidence"))
    mail = pair(_met(exploded("emails"), most), F.lit("high"), F.concat(F.lit("same email address "), "value"))
    numbers = exploded("phones").withColumn("full", F.col("value").startswith("+")).withColumn("digits", F.regexp_replace(F.regexp_replace("value", r"^\+", ""), "^0+", "")).withColumn("value", F.substring("digits", -7, 7))
    met = _met(numbers, most)
    short, long = F.when(F.length("digits_a") <= F.length("digits_b"), F.col("digits_a")).otherwise(F.col("digits_b")), F.when(F.length("digits_a") <= F.length("digits_b"), F.col("digits_b")).otherwise(F.col("digits_a"))
    both = F.col("full_a") & F.col("full_b")
    same = F.when(both, F.when(F.col("digits_a") == F.col("digits_b"), "high")).when(F.col("digits_a") == F.col("digits_b"), F.when(F.col("full_a") | F.col("full_b"), "medium").otherwise("high"))
    same = same.when((F.length(short) >= 7) & F.endswith(long, short) & (F.length(long) - F.length(short) <= 3), "medium")
    phone = pair(met.withColumn("sure", same).where("sure IS NOT NULL"), F.col("sure"), F.when(F.col("sure") == "high", F.concat(F.lit("same phone number "), "digits_a")).otherwise(F.lit("phone numbers agree apart from the country code")))
    ids = people.select(*common, F.explode("ids").alias("platform", "id")).where(~F.col("platform").isin(*LOCAL) & ~F.col("platform").rlike("(?i)email|phone|tel|own_handles") & (F.length("id") >= 3))
    handle = F.col("platform").isin(*HANDLES)
    ids = ids.select(*common, F.when(handle, F.concat(F.lit("handle:"), F.lower(F.regexp_replace("id", "^@", "")))).otherwise(F.concat_ws(":", "platform", "id")).alias("value"))
    met = _met(ids, most)
    apart = F.col("value").startswith("handle:") & (F.col("ns_a") != F.col("ns_b"))
    platform = pair(met, F.when(apart, "low").otherwise("high"), F.when(apart, F.concat(F.lit("same user name "), F.substring("value", 8, 100), F.lit(" on different services"))).otherwise(F.concat(F.lit("same id "), "value")))
    names = exploded("names")
    crowd = names.groupBy("value", "ns").agg(F.count_distinct("node").alias("share"))
    names = names.join(crowd, ["value", "ns"])
    met = _met(names, most)
    shared = (F.col("share_a") > 1) | (F.col("share_b") > 1)
    sure = F.when(shared | F.col("alter_a") | F.col("alter_b"), "low").when(F.col("value").contains(" ") & (F.col("ns_a") != F.col("ns_b")), "medium").otherwise("low")
    called = pair(met, sure, F.concat(F.lit("same name "), "value", F.when(shared, " (shared by several people in one source)").otherwise("")))
    spelt = _spelt(people, most)
    proposed = reduce(DataFrame.unionByName, [mail, phone, platform, called, spelt])
    rank = F.element_at(F.create_map(*[F.lit(x) for kv in RANK.items() for x in kv]), F.col("confidence"))
    best = proposed.groupBy("a", "b").agg(F.max_by("confidence", rank).alias("confidence"), F.array_sort(F.collect_set("evidence")).alias("evidence"))
    key = lambda c: nodes.select(F.col("node_id").alias(c), F.col("key").alias(f"key_{c}"))
    rank = F.element_at(F.create_map(*[F.lit(x) for kv in RANK.items() for x in kv]), F.col("confidence"))
    return best.join(key("a"), "a").join(key("b"), "b").select("a", "b", "key_a", "key_b", "confidence", "evidence").orderBy(F.desc(rank), "key_a", "key_b")


def _spelt(people: DataFrame, most: int) -> DataFrame:
    """Addresses whose local part spells another's name in full, or its initial and surname."""
    local = people.select("node", "is_bot", F.explode("emails").alias("mail")).select("node", "is_bot", "mail", F.filter(F.split(words.unaccented(F.regexp_replace(F.substring_index("mail", "@", 1), r"\+.*$", "")), "[._-]+"), lambda x: x != "").alias("parts"))
    full = F.array(F.array_join("parts", " "), F.array_join(F.reverse("parts"), " "))
    forms = local.where(F.size("parts") >= 2).select("node", "is_bot", "mail", F.explode(F.array_distinct(full)).alias("value"), F.lit("words").alias("how"))
    forms = forms.unionByName(local.select("node", "is_bot", "mail", F.array_join("parts", "").alias("value"), F.lit("joined").alias("how")))
    named = people.select(F.col("node").alias("other"), F.col("is_bot").alias("bot"), "alter", F.col("label"), F.explode("names").alias("name")).where("name LIKE '% %'").withColumn("ws", F.split("name", " "))
    whole, initial = F.array_join("ws", ""), F.concat(F.substring(F.col("ws")[0], 1, 1), F.element_at("ws", -1))
    targets = named.select("other", "bot", "alter", "label", F.explode(F.array(F.struct(F.col("name").alias("value"), F.lit("words").alias("how"), F.lit(True).alias("full")), F.struct(whole.alias("value"), F.lit("joined").alias("how"), F.lit(True).alias("full")), F.struct(initial.alias("value"), F.lit("joined").alias("how"), F.lit(False).alias("full")))).alias("x")).select("other", "bot", "alter", "label", "x.*")
    bounded = targets.join(targets.groupBy("value", "how").agg(F.count_distinct("other").alias("size")).where(F.col("size") <= most), ["value", "how"])
    met = forms.join(bounded, ["value", "how"]).where("node <> other AND is_bot = bot")
    many = F.count("*").over(Window.partitionBy("node", "mail", "how", "value")) > 1
    met = met.withColumn("many", many).groupBy("node", "other", "mail", "label").agg(F.bool_or("full").alias("full"), F.bool_and("many").alias("many"), F.bool_or("alter").alias("alter"))
    sure = F.when(F.col("full") & ~F.col("many") & ~F.col("alter"), "medium").otherwise("low")
    told = F.concat(F.lit("email "), "mail", F.when(F.col("full"), " spells the name ").otherwise(" matches the initial and surname of "), F.coalesce("label", F.lit("")))
    return met.select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b"), sure.alias("confidence"), told.alias("evidence"))


# ---- merging ----


def _mapped_targets(events: DataFrame, numbers: DataFrame) -> DataFrame:
    """Events with actor and targets replaced by numbers (old, new); a target that is the actor then, or is named again in its role, goes."""
    who = numbers.select(F.col("old").alias("actor"), F.col("new").alias("_actor"))
    events = events.join(who, "actor", "left").withColumn("actor", F.coalesce("_actor", "actor")).drop("_actor")
    flat = events.where("size(targets) > 0").select("event_id", "actor", F.posexplode("targets").alias("pos", "x")).select("event_id", "actor", "pos", F.col("x.node").alias("old"), F.col("x.role").alias("role"))
    flat = flat.join(numbers, "old", "left").withColumn("node", F.coalesce("new", "old")).where("node <> actor")
    first = flat.groupBy("event_id", "node", "role").agg(F.min("pos").alias("pos"))
    listed = first.groupBy("event_id").agg(F.array_sort(F.collect_list(F.struct("pos", "node", "role"))).alias("listed"))
    return events.drop("targets").join(listed, "event_id", "left").withColumn("targets", F.expr("transform(coalesce(listed, array()), x -> named_struct('node', x.node, 'role', x.role))")).drop("listed")


def apply_merges(ds: Dataset, pairs: DataFrame) -> tuple[Dataset, DataFrame]:
    """(dataset, log) with the nodes of each group of pairs (a, b) merged into the one with most events, the lowest on ties. Attributes of the one kept win, then those of lower
    nodes; log (into, merged, key, attr, kept, dropped) tells conflicts."""
    groups = components.linked(pairs.where("a <> b"), "a", "b")
    groups = storage.materialize(groups, "groups")
    active = ds.events.groupBy(F.col("actor").alias("node")).agg(F.count("*").alias("n"))
    weighed = groups.join(active, "node", "left").fillna(0, ["n"])
    best = weighed.groupBy("component").agg(F.max_by("node", F.struct("n", (-F.col("node")).alias("low"))).alias("new"))
    numbers = storage.materialize(groups.join(best, "component").select(F.col("node").alias("old"), "new"), "numbers")
    members = numbers.join(ds.nodes.withColumnRenamed("node_id", "old"), "old")
    order = F.struct((F.col("old") != F.col("new")).alias("other"), F.col("old").alias("at"))
    values = members.select("old", "new", "key", F.explode("attrs").alias("attr", "value"))
    kept = values.groupBy("new", "attr").agg(F.min_by("value", order).alias("value"))
    log = values.join(kept.withColumnRenamed("value", "kept"), ["new", "attr"]).where("value <> kept").select(F.col("new").alias("into"), F.col("old").alias("merged"), "key", "attr", "kept", F.col("value").alias("dropped"))
    attrs = kept.groupBy("new").agg(F.map_from_entries(F.collect_list(F.struct("attr", "value"))).alias("attrs"))
    keys = members.groupBy("new").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), "key"))), lambda x: x["key"]), " | ").alias("merged_keys"), F.bool_or("is_bot").alias("bot"))
    held = keys.join(attrs, "new", "left").select(F.col("new").alias("node_id"), "bot", F.map_concat(F.coalesce(F.map_filter("attrs", lambda k, _: k != "merged_keys"), F.create_map().cast("map<string, string>")), F.create_map(F.lit("merged_keys"), "merged_keys")).alias("own"))
    gone = numbers.where("old <> new").select(F.col("old").alias("node_id"))
    nodes = ds.nodes.join(gone, "node_id", "left_anti").join(held, "node_id", "left")
    nodes = nodes.withColumn("attrs", F.coalesce("own", "attrs")).withColumn("is_bot", F.coalesce("bot", "is_bot")).drop("own", "bot")
    return replace(ds, nodes=nodes, events=_mapped_targets(ds.events, numbers)), log


def merge(datasets: list[Dataset]) -> Dataset:
    """The union of datasets: nodes and contexts of one key are one, with the first dataset's attributes and the first label that is more than the key's tail; sources stay apart."""
    nodes, contexts, events, sources, offset = None, None, None, None, 0
    for i, ds in enumerate(datasets):
        number = base.number("key")
        own = ds.nodes.withColumn("_order", F.lit(i)).withColumn("_old", F.col("node_id")).withColumn("node_id", F.coalesce(number, F.col("node_id")))
        places = ds.contexts.withColumn("_order", F.lit(i)).withColumn("_old", F.col("context_id")).withColumn("context_id", F.coalesce(number, F.col("context_id")))
        renumbered = own.where("_old <> node_id").select(F.col("_old").alias("old"), F.col("node_id").alias("new"))
        moved = ds.events.drop("mult")
        if not renumbered.isEmpty():
            moved = _mapped_targets(moved, own.select(F.col("_old").alias("old"), F.col("node_id").alias("new")))
        moved = moved.join(places.select(F.col("_old").alias("context"), F.col("context_id").alias("_context")), "context", "left").withColumn("context", F.col("_context")).drop("_context")
        fresh = lambda c, i=i: F.when(F.col(c).isNotNull(), F.shiftrightunsigned(F.xxhash64(F.lit(i), F.col(c)), 1))
        moved = moved.withColumn("parent", fresh("parent")).withColumn("event_id", fresh("event_id")).withColumn("source", F.col("source") + offset)
        listed = ds.sources.withColumn("source_id", F.col("source_id") + offset)
        offset += (ds.sources.agg(F.max("source_id")).collect()[0][0] or 0) + 1
        joined = lambda a, b: b if a is None else a.unionByName(b, allowMissingColumns=True)
        nodes, contexts, events, sources = joined(nodes, own.drop("_old")), joined(contexts, places.drop("_old")), joined(events, moved), joined(sources, listed)
    tail = F.substring_index("key", ":", -1)
    better = F.when(F.col("label") != tail, F.col("label"))
    attrs = nodes.select("node_id", "_order", F.explode("attrs").alias("k", "v")).groupBy("node_id", "k").agg(F.min_by("v", "_order").alias("v")).groupBy("node_id").agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("attrs"))
    people = nodes.groupBy("node_id").agg(F.min_by("key", "_order").alias("key"), F.coalesce(F.min_by(better, F.when(better.isNotNull(), F.col("_order"))), F.min_by("label", "_order")).alias("label"), F.bool_or(F.coalesce("is_bot", F.lit(False))).alias("is_bot"), F.max("mode").alias("mode"))
    places = contexts.groupBy("context_id").agg(*[F.min_by(c, "_order").alias(c) for c in ("key", "name", "kind", "visibility", "medium")])
    return Dataset.of(people.join(attrs, "node_id", "left"), events, places, sources)


# ---- profiles ----


def column_type(values: DataFrame, column: str) -> str:
    """numeric, boolean, date, id, categorical or text, from a column's non-blank values."""
    held = values.where(F.trim(F.col(column)) != "").select(F.trim(F.col(column)).alias("v"))
    row = held.agg(F.count("*").alias("n"), F.count_distinct("v").alias("d"), F.bool_and(F.expr("try_cast(v AS double)").isNotNull()).alias("num"), F.bool_and(F.lower("v").isin("true", "false", "yes", "no")).alias("yes"), F.bool_and(F.col("v").rlike(r"^\d{4}-\d{2}-\d{2}([T ].*)?$")).alias("date")).collect()[0]
    if not row["n"]:
        return "text"
    if row["yes"]:
        return "boolean"
    if row["num"]:
        return "numeric"
    if row["date"]:
        return "date"
    if row["d"] == row["n"] and row["n"] > 20:
        return "id"
    return "categorical" if row["d"] <= max(12, row["n"] * 0.5) else "text"


def join_profiles(ds: Dataset, table: DataFrame, key_column: str, match_on: str = "email", columns: list[str] | None = None, overwrite: bool = True) -> tuple[Dataset, DataFrame]:
    """(dataset, report): attributes of a table joined to people by their email, key, label or another attribute: exact values first, then normalised ones. A row that matches
    several people, and people whom several rows match, are left alone. report (row, key, outcome, node)."""
    columns = [c for c in (columns or table.columns) if c != key_column]
    rows = storage.materialize(table.select(F.monotonically_increasing_id().alias("row"), *[F.col(f"`{c}`").cast("string").alias(c) for c in table.columns]), "profiles")
    people = _people(ds.nodes)
    value = {"email": F.explode("emails"), "name": F.explode("names")}.get(match_on)
    if value is not None:
        known = people.select("node", value.alias("value"))
        if match_on == "name":
            known = known.unionByName(people.select("node", F.col("label").alias("value")))
    else:
        of = F.col(match_on) if match_on in ("key", "label") else F.col("attrs")[match_on]
        known = ds.nodes.select(F.col("node_id").alias("node"), of.alias("value")).where("value IS NOT NULL")
    keyed = rows.select("row", F.trim(F.coalesce(F.col(f"`{key_column}`"), F.lit(""))).alias("raw"))
    exact = keyed.join(known.distinct(), F.col("raw") == F.col("value")).select("row", "raw", "node", F.lit("exact").alias("how"))
    loose = keyed.join(exact.select("row").distinct(), "row", "left_anti").where("raw <> ''")
    loose = loose.withColumn("plain", words.unaccented(F.col("raw"))).join(known.select("node", words.unaccented(F.col("value")).alias("plain")).distinct(), "plain").select("row", "raw", "node", F.lit("normalized").alias("how"))
    hits = storage.materialize(exact.unionByName(loose).distinct(), "hits")
    per_row = hits.groupBy("row").agg(F.count_distinct("node").alias("people"))
    single = hits.join(per_row.where("people = 1"), "row")
    per_node = single.groupBy("node").agg(F.count_distinct("row").alias("claims"))
    matched = storage.materialize(single.join(per_node.where("claims = 1"), "node").select("row", "node", "how"), "matched")
    outcome = keyed.join(per_row, "row", "left").join(matched, "row", "left").select("row", F.col("raw").alias("key"), F.when(F.col("how").isNotNull(), F.col("how")).when(F.col("raw") == "", "empty key").when(F.col("people") > 1, "several people").when(F.col("people") == 1, "several rows").otherwise("no match").alias("outcome"), "node")
    entries = F.map_filter(F.map_from_arrays(F.array(*[F.lit(c) for c in columns]), F.array(*[F.trim(F.col(f"`{c}`")) for c in columns])), lambda _, v: v.isNotNull() & (v != ""))
    given = matched.join(rows.select("row", entries.alias("given")), "row").select(F.col("node").alias("node_id"), "given")
    empty = F.create_map().cast("map<string, string>")
    old = F.coalesce("attrs", empty)
    new = F.map_concat(F.map_filter(old, lambda k, _: ~F.map_contains_key("given", k)), F.col("given")) if overwrite else F.map_concat(old, F.map_filter("given", lambda k, _: ~F.map_contains_key(old, k)))
    nodes = ds.nodes.join(given, "node_id", "left").withColumn("attrs", F.when(F.col("given").isNotNull(), new).otherwise(F.col("attrs"))).drop("given")
    return replace(ds, nodes=nodes), outcome


def duplicate_names(nodes: DataFrame, most: int = 2) -> DataFrame:
    """(a, b, reason): people whose names may be one: equal when normalised, an initial for a first name beside the same surname, or a few letters apart. Names are met
    within blocks of a surname and of a first letter with a length, never all with all."""
    named = nodes.select(F.col("node_id").alias("node"), words.name_tokens(F.col("label")).alias("ws")).where("size(ws) > 0").withColumn("name", F.array_join("ws", " "))
    last, first = F.element_at("ws", -1), F.col("ws")[0]
    blocks = named.select("node", "name", "ws", F.explode(F.array(F.concat(F.lit("last:"), last), F.concat(F.lit("head:"), F.substring("name", 1, 2), F.floor(F.length("name") / 3).cast("string")), F.concat(F.lit("head:"), F.substring("name", 1, 2), (F.floor(F.length("name") / 3) + 1).cast("string")))).alias("value")).withColumn("first", first)
    met = _met(blocks.select("value", "node", "name", "first", F.element_at("ws", -1).alias("last")), MOST_IN_BUCKET * 4)
    near = F.levenshtein("name_a", "name_b", most)
    initial = (F.col("last_a") == F.col("last_b")) & (F.substring("first_a", 1, 1) == F.substring("first_b", 1, 1)) & ((F.length("first_a") == 1) | (F.length("first_b") == 1)) & (F.col("first_a") != F.col("first_b"))
    reason = F.when(F.col("name_a") == F.col("name_b"), "same name").when(initial, "initial").when((near >= 0) & (F.least(F.length("name_a"), F.length("name_b")) >= 5), "spelling")
    return met.select(F.col("node_a").alias("a"), F.col("node_b").alias("b"), reason.alias("reason")).where("reason IS NOT NULL").distinct()
