"""Layered retrieval and the lookups around it, for many items at a time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexispark.functions.text import format_ref, letters_of, parse_ref
from lexispark.session import with_global_rank


def current_labels(labels: DataFrame, include_test: bool = False) -> DataFrame:
    """unit_id, label: the label in force; test rows only when asked for."""
    rows = labels.where("is_current")
    if not include_test:
        rows = rows.where("not is_test")
    return rows.select("unit_id", "label")


def occurrences_by_item(tokens: DataFrame, items: DataFrame, units: DataFrame, labels: DataFrame | None = None,
                        item: str = "root") -> DataFrame:
    """Layer 1: every token of the items with its unit (and label)."""
    hits = tokens.join(items, item, "left_semi").join(units, "unit_id")
    if labels is not None:
        hits = hits.join(labels, "unit_id", "left")
    return hits.withColumn("layer", F.lit(1))


def field_siblings(members: DataFrame, items: DataFrame) -> DataFrame:
    """Confirmed members of the items' confirmed fields, other than the item: item, member_type, sibling.

    ``members`` has field_id, member_type, item, status. An item whose fields have no other member
    gets no rows.
    """
    confirmed = members.where(F.col("status") == "confirmed").select("field_id", "member_type", "item")
    own = confirmed.where(F.col("member_type") == "root").join(items, "item", "left_semi").select(
        "field_id", F.col("item").alias("_of"))
    found = own.join(confirmed, "field_id").where(
        (F.col("member_type") != "root") | (F.col("item") != F.col("_of")))
    return found.select(F.col("_of").alias("item"), "member_type", F.col("item").alias("sibling")).distinct()


def occurrences_by_field(tokens: DataFrame, members: DataFrame, items: DataFrame,
                         keep: Sequence[str] = ("token_id", "unit_id")) -> DataFrame:
    """Layer 2: tokens of sibling roots or sibling lemmas. Two equi-joins instead of one OR join."""
    siblings = field_siblings(members, items)

    def part(kind: str) -> DataFrame:
        wanted = siblings.where(F.col("member_type") == kind).select(F.col("item").alias("of_item"), F.col("sibling").alias(kind))
        return tokens.join(wanted, kind).select("of_item", *keep)

    return part("root").unionByName(part("lemma")).distinct().withColumn("layer", F.lit(2))


def related_units(edges: DataFrame, unit_set: DataFrame) -> DataFrame:
    """Layer 3: other ends of confirmed edges that touch the set.

    ``edges`` has edge_id, a, b, relation, status. With both ends in the set the edge counts
    once and yields b.
    """
    confirmed = edges.where(F.col("status") == "confirmed").select("edge_id", "a", "b", "relation")
    touching = unit_set.select("unit_id").distinct()
    from_a = confirmed.join(touching, confirmed.a == touching.unit_id, "left_semi").select(
        "edge_id", "relation", F.col("b").alias("unit_id"), F.lit(0).alias("_from"))
    from_b = confirmed.join(touching, confirmed.b == touching.unit_id, "left_semi").select(
        "edge_id", "relation", F.col("a").alias("unit_id"), F.lit(1).alias("_from"))
    best = from_a.unionByName(from_b).groupBy("edge_id", "relation").agg(
        F.min(F.struct("_from", "unit_id")).alias("_best"))
    return best.select("edge_id", "relation", F.col("_best.unit_id").alias("unit_id"), F.lit(3).alias("layer"))


def union_layers(*layers: DataFrame) -> DataFrame:
    """Distinct units over the layers, labelled with the first layer that found them."""
    rows = None
    for layer in layers:
        part = layer.select("unit_id", "layer")
        rows = part if rows is None else rows.unionByName(part)
    return rows.groupBy("unit_id").agg(F.min("layer").alias("layer"))


def item_layers(tokens: DataFrame, members: DataFrame, edges: DataFrame, items: DataFrame) -> DataFrame:
    """(item, layer, unit_id, ref_id): the three retrieval layers of many items at a time.

    Layer 1 has the tokens of the item, layer 2 those of its fields' other members, layer 3 the other ends of confirmed
    edges that touch a unit of layer 1; ref_id is the token's or the edge's id. ``items`` has item, the root. An edge
    that touches an item's units with both ends counts once for that item and yields b. A unit that holds an item many
    times is one row before edges are looked up, and each side of an edge is found by an equi-join on the unit.
    """
    roots = items.select(F.col("item").alias("root")).distinct()
    first = tokens.join(roots, "root", "left_semi").select(
        F.col("root").alias("item"), F.lit(1).alias("layer"), "unit_id", F.col("token_id").alias("ref_id"))
    second = occurrences_by_field(tokens, members, items.select("item").distinct()).select(
        F.col("of_item").alias("item"), "layer", "unit_id", F.col("token_id").alias("ref_id"))
    own = first.select("item", F.col("unit_id").alias("_u")).distinct()
    confirmed = edges.where(F.col("status") == "confirmed")

    def side(near: str, far: str, turn: int) -> DataFrame:
        return confirmed.join(own, F.col(near) == F.col("_u")).select(
            "item", "edge_id", F.struct(F.lit(turn).alias("turn"), F.col(far).alias("unit_id")).alias("_end"))

    third = side("a", "b", 0).unionByName(side("b", "a", 1)).groupBy("item", "edge_id").agg(F.min("_end").alias("_end")).select(
        "item", F.lit(3).alias("layer"), F.col("_end.unit_id").alias("unit_id"), F.col("edge_id").alias("ref_id"))
    return first.unionByName(second).unionByName(third)


def units_of_layers(layers: DataFrame) -> DataFrame:
    """(item, unit_id, layer): every unit of an item once, with the first layer that found it.

    The smallest layer per item and unit is taken in every task before the rows meet, so a hot item is reduced first.
    """
    return layers.groupBy("item", "unit_id").agg(F.min("layer").alias("layer"))


def count_with_zero(dictionary: DataFrame, tokens: DataFrame, key: str, name: str = "occurrences") -> DataFrame:
    """Dictionary rows with their token count, zero included."""
    counts = tokens.groupBy(key).agg(F.count(F.lit(1)).alias(name))
    return dictionary.join(counts, key, "left").withColumn(name, F.coalesce(name, F.lit(0).cast("long")))


def preview_top(rows: DataFrame, by: Sequence[str], order: Sequence[Column], k: int = 20) -> DataFrame:
    """The first k rows per group plus the group's total.

    The rank filter limits each group inside every task before the shuffle; totals are a separate
    partial aggregate, so a group of any size is never sorted whole.
    """
    first = rows.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= k)
    totals = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("total"))
    return first.join(totals, list(by))


def surviving_tokens(tokens: DataFrame, occurrences: DataFrame) -> DataFrame:
    """Tokens outside non-first whole-unit phrases (whole unit out) and non-first endings (range out)."""
    masked = occurrences.where(~F.col("is_first"))
    whole = masked.where(F.col("kind") == "full_unit").select("unit_id")
    ends = masked.where(F.col("kind") == "final_ngram").select(F.col("unit_id").alias("_u"), "start_pos", "end_pos")
    rest = tokens.join(whole, "unit_id", "left_anti")
    return rest.join(ends, (rest.unit_id == ends["_u"]) & rest.pos.between(ends.start_pos, ends.end_pos), "left_anti")


def profile_counts(tokens: DataFrame, by: Sequence[str] = ("lemma",)) -> DataFrame:
    """Distinct (norm, sorted features) and distinct units per item.

    Two-step counting: duplicates of a frequent item disappear before its rows meet, and before features are sorted.
    Units of tokens dealt by unit are told apart where they are.
    """
    profile = F.struct(F.col("norm"), F.sort_array(F.coalesce("features", F.array().cast("array<string>"))))
    forms = tokens.select(*by, "norm", "features").distinct()
    profiles = forms.select(*by, profile.alias("_p")).distinct().groupBy(*by).agg(F.count(F.lit(1)).alias("profiles"))
    units = tokens.select(*by, "unit_id").distinct().groupBy(*by).agg(F.count(F.lit(1)).alias("n_units"))
    return profiles.join(units, list(by))


def morphology_profiles(tokens: DataFrame, by: str = "lemma") -> DataFrame:
    return tokens.select(by, "tag", "features").distinct()


def semi_fetch(units: DataFrame, retrieved: DataFrame) -> DataFrame:
    """Units whose id was retrieved."""
    return units.join(retrieved, "unit_id", "left_semi")


def empty_retrievals(requests: DataFrame, retrieved: DataFrame, key: str) -> DataFrame:
    """Requests with nothing retrieved; they are rejected rather than answered from nothing."""
    return requests.join(retrieved, key, "left_anti").withColumn("reason", F.lit("no units retrieved"))


def preferred_language(texts: DataFrame, key: str, language: str, columns: Sequence[str]) -> DataFrame:
    """One text per key: the wanted language if there is one, then the lowest source id.

    An aggregate, not a window: a key with very many texts is reduced in every task first.
    """
    rank = F.struct(F.when(F.col("lang") == language, 0).otherwise(1).alias("other"), "source_id")
    best = texts.groupBy(key).agg(F.min_by(F.struct(*columns), rank).alias("_best"))
    return best.select(key, "_best.*")


def decompose_letters(tokens: DataFrame, letters: DataFrame, key: str = "token_id", norm: str = "norm") -> DataFrame:
    """One row per letter of the token that the letter dictionary knows, numbered as in the token."""
    spread = tokens.select(key, F.posexplode(letters_of(F.col(norm))).alias("letter_pos", "letter"))
    return spread.join(letters, "letter")


def unit_bundle(units: DataFrame, tokens: DataFrame, labels: DataFrame, texts: DataFrame,
                glosses: DataFrame, segments: DataFrame, tasks: int | None = None) -> DataFrame:
    """One nested row per unit: label, preferred text, ordered tokens with gloss and segments.

    ``glosses`` and ``segments`` have token_id and, as tokens do, unit_id. Each travels by unit once: a token meets what
    belongs to it, and the unit its tokens, where that exchange has put them; what is dealt by unit in ``tasks``
    partitions already stays there. The token array is as long as the unit's own text, which already is one value, and
    so are the lists of glosses and segments that meet it.
    """
    token = tokens.repartition(*([tasks] if tasks else []), "unit_id").select("unit_id", "token_id", F.struct("pos", "form").alias("token"))
    parts = {"token": token, "gloss": glosses, "segments": segments}
    empty = {name: F.lit(None).cast(rows.schema[name].dataType) for name, rows in parts.items()}

    def held(name: str) -> DataFrame:
        one = F.struct("token_id", *[F.col(c) if c == name else none.alias(c) for c, none in empty.items()])
        return parts[name].groupBy("unit_id").agg(F.collect_list(one).alias("_" + name))

    together = held("token").join(held("gloss"), "unit_id", "left").join(held("segments"), "unit_id", "left").select(
        "unit_id", F.inline(F.concat(*[F.coalesce("_" + name, F.array()) for name in parts])))
    per_token = together.groupBy("unit_id", "token_id").agg(
        F.max("token").alias("token"), F.max("gloss").alias("gloss"), F.first("segments", ignorenulls=True).alias("segments"))
    per_unit = per_token.where("token is not null").groupBy("unit_id").agg(F.sort_array(F.collect_list(F.struct(
        F.col("token.pos").alias("pos"), "token_id", F.col("token.form").alias("form"), "gloss", "segments"))).alias("tokens"))
    return units.join(labels, "unit_id", "left").join(texts, "unit_id", "left").join(per_unit, "unit_id", "left")


def resolve_examples(examples: DataFrame, units: DataFrame, texts: DataFrame) -> DataFrame:
    """Published curated pairs in display order with the units of both references."""
    shown = with_global_rank(
        examples.where("is_current"),
        [F.desc("is_locked"), F.asc_nulls_first("sort_order"), F.asc("example_id")], "number")
    sides = shown.select("number", "example_id", F.inline(F.array(
        F.struct(F.lit("a").alias("side"), F.col("ref_a").alias("ref")),
        F.struct(F.lit("b").alias("side"), F.col("ref_b").alias("ref")))))
    return units_of_refs(sides, units).join(texts, "unit_id", "left")


_SPAN = 4096    # numbers handled together when a range of units is spread


def _parsed(rows: DataFrame, ref: str) -> DataFrame:
    """Rows with a usable reference, once per span of numbers that it touches."""
    parsed = rows.withColumn("_r", parse_ref(F.col(ref))).where(F.col("_r.error").isNull())
    spans = F.sequence(F.floor(F.col("_r.first") / _SPAN), F.floor(F.col("_r.last") / _SPAN))
    return parsed.withColumn("section", F.col("_r.section")).withColumn("_span", F.explode(spans))


def expand_refs(rows: DataFrame, ref: str = "ref") -> DataFrame:
    """One row per unit number of a reference; bad references are left out (see :func:`bad_refs`).

    A long range is spread in spans, so no row ever holds all of its numbers.
    """
    low = F.greatest(F.col("_r.first").cast("long"), F.col("_span") * _SPAN)
    high = F.least(F.col("_r.last").cast("long"), F.col("_span") * _SPAN + (_SPAN - 1))
    spread = F.transform(F.sequence(low, high), lambda n: n.cast("int"))
    return _parsed(rows, ref).withColumn("seq", F.explode(spread)).drop("_r", "_span")


def units_of_refs(rows: DataFrame, units: DataFrame, ref: str = "ref") -> DataFrame:
    """The existing units (section, seq) of each reference; numbers without a unit are never made."""
    placed = units.withColumn("_span", F.floor(F.col("seq") / _SPAN))
    return _parsed(rows, ref).join(placed, ["section", "_span"]).where(
        F.col("seq").between(F.col("_r.first"), F.col("_r.last"))).drop("_r", "_span")


def bad_refs(rows: DataFrame, ref: str = "ref") -> DataFrame:
    parsed = rows.withColumn("_r", parse_ref(F.col(ref))).where(F.col("_r.error").isNotNull())
    return parsed.withColumn("error", F.col("_r.error")).drop("_r")


def unit_rule_legend(annotations: DataFrame, rules: DataFrame, units: DataFrame) -> DataFrame:
    """Distinct known rules per unit with their label; units without any keep one row with nulls."""
    used = annotations.select("unit_id", "rule").distinct().join(rules, "rule")
    return units.select("unit_id").join(used, "unit_id", "left").withColumn("has_any", F.col("rule").isNotNull())


def tag_vs_substring(tokens: DataFrame, units: DataFrame, item: str, value: str) -> DataFrame:
    """Units by exact item against units whose text merely contains it; one row."""
    none = F.lit(0).cast("long")
    exact = tokens.where(F.col(item) == value).select("unit_id").distinct().agg(F.count(F.lit(1)).alias("by_item"))
    loose = units.where(F.contains("text_norm", F.lit(value))).agg(F.count(F.lit(1)).alias("by_substring"))
    both = exact.withColumn("by_substring", none).unionByName(loose.withColumn("by_item", none))
    return both.agg(F.max("by_item").alias("by_item"), F.max("by_substring").alias("by_substring")).withColumn(
        "differs", F.col("by_item") != F.col("by_substring"))


def with_ref(rows: DataFrame, *parts: str, name: str = "ref") -> DataFrame:
    return rows.withColumn(name, format_ref(*[F.col(c).cast("string") for c in parts]))


def item_dossier(tokens: DataFrame, letters: DataFrame, dictionary: DataFrame, layers: DataFrame,
                 statistics: DataFrame, item: str = "root") -> DataFrame:
    """Everything known about a set of tokens in one row each.

    ``layers`` is the output of :func:`preview_top` keyed by token_id and layer, so the arrays are
    bounded by the preview size.
    """
    spelled = decompose_letters(tokens, letters).groupBy("token_id").agg(
        F.sort_array(F.collect_list(F.struct("letter_pos", "letter", "name"))).alias("letters"))
    previews = layers.groupBy("token_id").agg(F.sort_array(F.collect_list(
        F.struct("layer", "rank", "total", "unit_id"))).alias("retrieval"))
    return (
        tokens.join(spelled, "token_id", "left")
        .join(dictionary, item, "left")
        .join(previews, "token_id", "left")
        .join(statistics, item, "left")
    )


def layer_previews(layers: DataFrame, items: DataFrame, k: int = 20) -> DataFrame:
    """(item, retrieval): per item an array with layer, total and the first ``k`` rows of all three layers.

    Rows are ordered by unit, then by token or edge. A layer that found nothing has total 0 and no rows. The arrays hold
    at most three times ``k`` rows, whatever the item's size.
    """
    shown = preview_top(layers, ["item", "layer"], [F.asc("unit_id"), F.asc("ref_id")], k).groupBy("item", "layer").agg(
        F.max("total").alias("total"), F.sort_array(F.collect_list(F.struct("rank", "unit_id", "ref_id"))).alias("preview"))
    every = items.select("item").distinct().select("item", F.explode(F.array(*[F.lit(i) for i in (1, 2, 3)])).alias("layer"))
    filled = every.join(shown, ["item", "layer"], "left").withColumn("total", F.coalesce("total", F.lit(0).cast("long")))
    return filled.groupBy("item").agg(F.sort_array(F.collect_list(F.struct("layer", "total", "preview"))).alias("retrieval"))


def word_dossier(words: DataFrame, letters: DataFrame, fields: DataFrame, previews: DataFrame, statistics: DataFrame,
                 analyses: DataFrame) -> DataFrame:
    """Everything known about each word in one row: letters, dictionary entry, three layers, statistics, analysis.

    ``words`` has token_id, root, lemma, norm. ``fields`` is keyed by root, ``previews`` comes from
    :func:`layer_previews`, ``statistics`` (lemma, statistics) holds the nested item views of the published build, and
    ``analyses`` (lemma, analysis) the published version about a lemma. A word without root has no layers, one without
    lemma neither statistics nor analysis. All nested values are bounded: by the word's length, the preview size, and the
    number of partners shown.
    """
    spelled = decompose_letters(words, letters).groupBy("token_id").agg(
        F.sort_array(F.collect_list(F.struct("letter_pos", "letter", "name"))).alias("letters"))
    return (
        words.join(spelled, "token_id", "left")
        .join(fields, "root", "left")
        .join(previews.withColumnRenamed("item", "root"), "root", "left")
        .join(statistics, "lemma", "left")
        .join(analyses, "lemma", "left")
    )
