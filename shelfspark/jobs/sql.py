"""Pieces of SQL that twins of the rule queries share."""

from __future__ import annotations

from shelfspark.functions import rules as R
from shelfspark.functions.labels import SKIN_IN_CONTEXT


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def first(c: str, rules: R.Rules) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({c}, {q(rx)}) THEN {q(label)}" for label, rx in rules) + " END"


def every(c: str, rules: R.Rules) -> str:
    return "list_filter([" + ", ".join(f"CASE WHEN regexp_matches({c}, {q(rx)}) THEN {q(label)} END" for label, rx in rules) + "], lambda x: x IS NOT NULL)"


def clean(c: str) -> str:
    return f"CASE WHEN {c} IS NULL OR regexp_replace({c}, '^\\s+|\\s+$', '', 'g') IN ('', 'None') THEN NULL ELSE replace(lower({c}), '_', ' ') END"


def single(c: str, rules: R.Rules) -> str:
    """Of an already cleaned column."""
    return f"CASE WHEN {c} IS NULL THEN NULL ELSE coalesce(list_filter(list_transform(regexp_split_to_array({c}, '[,/;&]'), lambda p: {first('p', rules)}), lambda x: x IS NOT NULL)[1], 'other') END"


def multi(c: str, rules: R.Rules) -> str:
    return f"CASE WHEN {c} IS NULL THEN NULL ELSE {every(c, rules)} END"


def text(x: str) -> str:
    """A list as a string; null stays null, an empty list is ''."""
    return f"CASE WHEN {x} IS NULL THEN NULL WHEN len({x}) = 0 THEN '' ELSE array_to_string({x}, ',') END"


def free(c: str) -> str:
    return f"regexp_replace({c}, {q(R.FREE_FROM)}, ' ', 'g')"


def negated(c: str) -> str:
    return f"regexp_replace({free(c)}, {q(R.NEGATED)}, ' ', 'g')"


def actives(c: str) -> str:
    long = [r for r in R.ACTIVES if r[0] in R.LONG_ACTIVES]
    compact = f"regexp_replace({c}, '\\s+', '', 'g')"
    return f"list_sort(list_distinct(list_concat({every(c, R.ACTIVES)}, {every(compact, long)})))"


def skin(c: str) -> str:
    return f"list_sort({every(c, SKIN_IN_CONTEXT)})"


FOUR = "['dry', 'oily', 'combination', 'normal']"


def canonical(c: str) -> str:
    return f"list_sort(CASE WHEN len(list_intersect({c}, {FOUR})) = 4 OR list_contains({c}, 'all') THEN list_distinct(list_append(list_filter({c}, lambda x: NOT list_contains({FOUR}, x)), 'all')) ELSE list_distinct({c}) END)"


# cleaned values -> labels as sellers gave them
NORM = f"""cleaned AS (SELECT *, {clean('raw_form')} AS cf, {clean('raw_skin')} AS cs, {clean('raw_benefit')} AS cb, {clean('raw_active')} AS ca FROM items),
norm AS (SELECT *, {single('cf', R.FORMS)} AS form, {multi('cs', R.SKIN_TYPES)} AS skin, {multi('cb', R.BENEFITS)} AS benefit, {multi('ca', R.ACTIVES)} AS active FROM cleaned)"""

BODY = "coalesce(features, '') || chr(10) || coalesce(description, '')"
# tagged text -> sections -> labels
SECTIONS = f"""tagged AS (SELECT *, '[BIG] ' || coalesce(title, '') || chr(10) || regexp_replace({BODY}, '([.!?])\\s+', '\\1' || chr(10), 'g') AS tagged FROM items),
lines AS (SELECT item_id, unnest(string_split(tagged, chr(10))) AS raw, generate_subscripts(string_split(tagged, chr(10)), 1) AS pos FROM tagged),
lows AS (SELECT *, starts_with(raw, '[BIG] ') AS big, replace(lower(CASE WHEN starts_with(raw, '[BIG] ') THEN substr(raw, 7) ELSE raw END), '_', ' ') AS low FROM lines),
marked AS (SELECT *, CASE WHEN regexp_matches(low, {q(R.INGREDIENT_HEADER)}) THEN 'ingr' WHEN regexp_matches(low, {q(R.USAGE_HEADER)}) THEN 'skip' WHEN big THEN 'claim' END AS mark FROM lows),
states AS (SELECT *, coalesce(last_value(mark IGNORE NULLS) OVER (PARTITION BY item_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 'claim') AS now FROM marked),
kept AS (SELECT *, {negated('low')} AS line, now = 'claim' AND NOT regexp_matches(low, {q(R.USAGE_START)}) AS claims FROM states),
sections AS (SELECT item_id, coalesce(string_agg(line, ' ' ORDER BY pos) FILTER (claims), '') AS claim, coalesce(string_agg(line, ' ' ORDER BY pos) FILTER (claims AND big), '') AS bigs,
  regexp_replace(coalesce(string_agg(line, ' ' ORDER BY pos) FILTER (now = 'ingr'), ''), '-\\s+([a-z])', '\\1', 'g') AS ingr FROM kept GROUP BY item_id),
v2 AS (SELECT item_id, {first('bigs', R.FORMS_V2)} AS form, {skin('claim')} AS skin, list_sort({every('claim', R.BENEFITS_V2)}) AS benefit,
  {actives("(claim || ' ' || ingr)")} AS active, list_sort({every('bigs', R.ACTIVES)}) AS active_hero, substr(claim, 1, 300) AS evidence FROM sections)"""

LOW_TITLE = "lower(coalesce(title, ''))"
# one row an item with seller, text and merged labels
ATTRS = f"""bought AS (SELECT n.* FROM norm n WHERE item_id IN (SELECT item_id FROM inter)),
both_ AS (SELECT b.item_id, b.segment, b.store, b.price,
  CASE WHEN b.form IS NULL OR b.form = 'other' THEN [] ELSE [b.form] END AS form_seller, {canonical("coalesce(b.skin, [])")} AS skin_seller, coalesce(b.benefit, []) AS benefit_seller, coalesce(b.active, []) AS active_seller,
  coalesce({first(free(LOW_TITLE), R.FORMS_V2)}, v.form) AS tform, {canonical(f"list_distinct(list_concat(v.skin, {skin(free(LOW_TITLE))}))")} AS skin_text, v.benefit AS benefit_text, v.active AS active_text,
  list_sort({every(negated(LOW_TITLE), R.BENEFITS_V2)}) AS benefit_main, {actives(negated(LOW_TITLE))} AS active_main
  FROM bought b JOIN v2 v USING (item_id)),
attrs AS (SELECT *, CASE WHEN tform IS NULL THEN [] ELSE [tform] END AS form_text, CASE WHEN len(form_seller) > 0 THEN form_seller WHEN tform IS NULL THEN [] ELSE [tform] END AS form,
  {canonical("list_distinct(list_concat(skin_seller, skin_text))")} AS skin, list_sort(list_distinct(list_concat(benefit_seller, benefit_text))) AS benefit,
  list_sort(list_distinct(list_concat(active_seller, active_text))) AS active FROM both_)"""
