"""Column functions from texts to labels, and algebra of label arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfspark.functions import rules as R
from shelfspark.functions.text import clean_text, normalised_words, strip_free, strip_negation
from shelfspark.operators.joins import once_each


def no_labels() -> Column:
    return F.array().cast("array<string>")


def hits(c: Column, regex: str) -> Column:
    return c.rlike("(?U)" + regex)


def first_label(c: Column, rules: R.Rules) -> Column:
    """The label of the first rule that hits; null if none does."""
    out = F.lit(None).cast("string")
    for label, regex in reversed(rules):
        out = F.when(hits(c, regex), F.lit(label)).otherwise(out)
    return out


def all_labels(c: Column, rules: R.Rules) -> Column:
    """The labels of all rules that hit, in the order of the rules. Without a lambda, as Spark compiles nothing that stands in one."""
    return _known([F.when(hits(c, regex), F.lit(label)) for label, regex in rules])


def sorted_labels(c: Column, rules: R.Rules) -> Column:
    """The labels of all rules that hit, sorted: the rules are, before they are tried."""
    return all_labels(c, sorted(rules))


def _known(labels: list[Column]) -> Column:
    return F.array_except(F.array(*labels), F.array(F.lit(None).cast("string")))


def norm_single(c: Column, rules: R.Rules) -> Column:
    """One label: the first part of the value (at , / ; &) that a rule hits decides; 'other' if none; null for a blank value."""
    t = clean_text(c)
    parts = F.transform(F.split(t, "[,/;&]"), lambda p: first_label(p, rules))
    return F.when(t.isNotNull(), F.coalesce(F.get(F.array_compact(parts), 0), F.lit("other")))


def norm_multi(c: Column, rules: R.Rules) -> Column:
    """All labels in the order of the rules; empty if none; null for a blank value."""
    t = clean_text(c)
    return F.when(t.isNotNull(), all_labels(t, rules))


def as_label_array(c: Column) -> Column:
    """A single label as an array: null and 'other' are none."""
    return F.when(c.isNull() | c.isin("other", ""), no_labels()).otherwise(F.array(c))


def labels_or_none(c: Column) -> Column:
    """An array of labels without nulls and empty ones; null is none."""
    return F.coalesce(F.filter(c, lambda x: x.isNotNull() & (x != "")), no_labels())


def truth_labels(c: Column) -> Column:
    return F.filter(labels_or_none(c), lambda x: x != "other")


def canonical_skin(c: Column) -> Column:
    """All four base types, or 'all', stand for 'all'; sorted."""
    four = F.array(*[F.lit(x) for x in ("dry", "oily", "combination", "normal")])
    whole = (F.size(F.array_intersect(c, four)) == 4) | F.array_contains(c, "all")
    return F.array_sort(F.when(whole, F.array_union(F.array_except(c, four), F.array(F.lit("all")))).otherwise(F.array_distinct(c)))


def split_sections(tagged: Column, negation: bool = True) -> Column:
    """A struct of claim lines, big claim lines and ingredient lines of a tagged text.

    A line with an ingredient header starts the ingredients, else one with a
    usage header starts a skipped part, else a '[BIG] ' line starts claims
    again; other lines go with the ones before. Claim lines that begin like a
    usage note are left out. Each line gets a mark of its kind, the marked text
    is cut before the lines that start something, and each part goes where its
    first mark says: all in one row, without a shuffle, in time linear in the
    lines.
    """
    found = _sections(_parts(tagged), negation)
    return F.struct(*[c.alias(name) for name, c in zip(("claim", "big", "ingr"), found, strict=True)])


def _parts(tagged: Column) -> Column:
    """The marked lines of a tagged text, cut before those that start something."""

    def marked(raw: Column) -> Column:
        big = raw.startswith("[BIG] ")
        low = F.translate(F.lower(F.when(big, F.substring(raw, 7, 1 << 30)).otherwise(raw)), "_", " ")
        kind = F.when(hits(low, R.INGREDIENT_HEADER), "I").when(hits(low, R.USAGE_HEADER), "S").when(big, "B").otherwise("P")
        return F.concat(kind, F.when(hits(low, R.USAGE_START), "u").otherwise("-"), low)

    return F.split(F.array_join(F.transform(F.split(F.coalesce(tagged, F.lit("")), "\n"), marked), "\n"), r"\n(?=[ISB][u-])")


def _sections(parts: Column, negation: bool = True) -> tuple[Column, Column, Column]:
    """Claim lines, big claim lines and ingredient lines."""
    cleaned = strip_negation if negation else (lambda c: c)
    lines = lambda kinds: F.flatten(F.transform(F.filter(parts, lambda p: F.substring(p, 1, 1).isin(*kinds)), lambda p: F.split(p, "\n")))
    texts = lambda held: F.transform(held, lambda x: cleaned(F.substring(x, 3, 1 << 30)))
    claims = F.filter(lines("BP"), lambda x: F.substring(x, 2, 1) != "u")
    return texts(claims), texts(F.filter(claims, lambda x: x.startswith("B"))), texts(lines("I"))


def skin_rule(label: str, regex: str) -> str:
    """A skin rule with its context: 'skin' within 60 characters after, or 'skin type' within 90 before."""
    return regex if label == "all" else rf"(?:{regex})[\s\S]{{0,56}}skin|skin type[\s\S]{{0,81}}(?:{regex})"


SKIN_IN_CONTEXT: R.Rules = [(label, skin_rule(label, regex)) for label, regex in R.SKIN_TYPES_V2]


def skin_labels(c: Column) -> Column:
    return sorted_labels(c, SKIN_IN_CONTEXT)


def active_labels(c: Column, compact: Column | None = None) -> Column:
    """Actives in a text; long names also in the text without white space."""
    compact = F.regexp_replace(c, r"(?U)\s+", "") if compact is None else compact
    either = lambda label, regex: hits(c, regex) | hits(compact, regex) if label in R.LONG_ACTIVES else hits(c, regex)
    return _known([F.when(either(label, regex), F.lit(label)) for label, regex in sorted(R.ACTIVES)])


def with_text_labels(df: DataFrame, tagged: Column, prefix: str = "text_") -> DataFrame:
    """Add the labels of a tagged text by its sections: form, skin, benefit, active, active_hero, evidence.

    The sections are columns of their own before the rules see them, so that
    each is made once and not once for every rule; they are cut from an array,
    as a struct's fields would be made one by one, the text cut for each. Texts
    that many rows share are labelled once.
    """
    return once_each(df.withColumn("_tagged", tagged), ["_tagged"], lambda own: _labelled(own, F.col("_tagged"), prefix)).drop("_tagged")


def _labelled(df: DataFrame, tagged: Column, prefix: str) -> DataFrame:
    cut = df.withColumn("_parts", _parts(tagged))
    claim, big, ingr = (F.array_join(c, " ") for c in _sections(F.col("_parts")))
    cut = cut.withColumns({"_claim": claim, "_big": big, "_ingr": F.regexp_replace(ingr, r"(?U)-\s+(?=[a-z])", "")})
    cut = cut.withColumn("_source", F.concat("_claim", F.lit(" "), "_ingr")).withColumn("_compact", F.regexp_replace("_source", r"(?U)\s+", ""))
    claim, big = F.col("_claim"), F.col("_big")
    return cut.withColumns({
        f"{prefix}form": first_label(big, R.FORMS_V2),
        f"{prefix}skin": skin_labels(claim),
        f"{prefix}benefit": sorted_labels(claim, R.BENEFITS_V2),
        f"{prefix}active": active_labels(F.col("_source"), F.col("_compact")),
        f"{prefix}active_hero": sorted_labels(big, R.ACTIVES),
        f"{prefix}evidence": F.substring(claim, 1, 300),
    }).drop("_parts", "_claim", "_big", "_ingr", "_source", "_compact")


def with_text_labels_v1(df: DataFrame, text: Column, prefix: str = "text_") -> DataFrame:
    """Add the labels of a whole text by plain rules: form, skin, benefit, active, evidence. The text is made ready once for all of them."""
    cut = df.withColumn("_whole", F.coalesce(text, F.lit(""))).withColumn("_low", F.translate(F.lower("_whole"), "_", " ")).withColumn("_compact", F.regexp_replace("_low", r"(?U)\s+", ""))
    t = F.col("_low")
    return cut.withColumns({
        f"{prefix}form": first_label(t, R.FORMS),
        f"{prefix}skin": sorted_labels(t, R.STRICT_SKIN_TYPES),
        f"{prefix}benefit": sorted_labels(t, R.BENEFITS),
        f"{prefix}active": active_labels(t, F.col("_compact")),
        f"{prefix}evidence": F.substring("_whole", 1, 300),
    }).drop("_whole", "_low", "_compact")


def _low(title: Column) -> Column:
    return F.lower(F.coalesce(title, F.lit("")))


def title_form(title: Column) -> Column:
    return first_label(strip_free(_low(title)), R.FORMS_V2)


def title_skin(title: Column) -> Column:
    return skin_labels(strip_free(_low(title)))


def title_benefits(title: Column) -> Column:
    return sorted_labels(strip_negation(_low(title)), R.BENEFITS_V2)


def title_actives(title: Column) -> Column:
    return active_labels(strip_negation(_low(title)))


def evidence_supported(quote: Column, source: Column, share: float = 0.8) -> Column:
    """Whether a quote is in its source: as a substring, or with ``share`` of its words, repeats counted."""
    q, s = normalised_words(quote), normalised_words(source)
    words, there = F.split(q, " "), F.split(s, " ")
    inside = F.size(F.filter(words, lambda w: F.array_contains(there, w)))
    return (q != "") & (s.contains(q) | (inside / F.size(words) >= share))
