"""License phrases and signature rules, by DataFrame functions only.

Rules are those of named families (each with five forms: notice, tag, clause, name, version), of identifiers in an identifier
expression, and hand-written signatures of license bodies and statements (`license_rules`). The distinct words of a text
fetch the rules that have one of them as a keyword, and only those run; every match of a rule holds one of its keywords. A
detection inside another of at least its priority is suppressed; of equal spans the first in the order of labels stays.

Null texts are empty; each row has its own result, repeated rows and null ids too; texts may be of any length; an empty
table gives an empty result; extra columns are not read."""
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import FOLD, folded, once
from .license_rules import BASE, EXPRESSION, FAMILIES, FORM_PRIORITY, FORMS, SIGNATURES, WORDS

WORD = r"[0-9A-Za-z\x{80}-\x{10FFFF}]+"
_DETS = "cast(array() as array<struct<s:int,e:int,p:int,label:string>>)"
_BASE = "cast(array() as array<struct<p:int,label:string,w:int>>)"
_RULE = "array<struct<n:int,label:string,p:int,pat:string>>"


def rules() -> list[dict]:
    """label, p (0: by the form of the match), keys and pat of all rules in their order."""
    out = [(label, 0, keys.split(), "|".join(form.format(name) for form in FORMS)) for label, keys, name in FAMILIES]
    out += [(label, 4, ["spdx"], EXPRESSION.format(w)) for label, w in WORDS.items()]
    out += [(label, p, keys.split(), pat) for label, p, keys, pat in SIGNATURES]
    return [{"n": n, "label": label, "p": p, "keys": keys, "pat": f"(?<= )(?:{pat})(?= )"} for n, (label, p, keys, pat) in enumerate(out)]


def _fixed(value, kind: str) -> Column:
    """A constant of the plan, however many parts it has."""
    return F.from_json(F.lit(json.dumps(value)), kind)


def _rule(r: dict) -> dict:
    return {k: r[k] for k in ("n", "label", "p", "pat")}


def by_keyword() -> list[dict]:
    """key, rules: what each keyword fetches."""
    out: dict = {}
    for r in rules():
        for k in r["keys"]:
            out.setdefault(k, []).append(_rule(r))
    return [{"key": k, "rules": v} for k, v in sorted(out.items())]


def fetched(words: Column) -> Column:
    """The rules whose keywords are among the distinct words, each once."""
    table = by_keyword()
    keys = F.array_intersect(words, _fixed([t["key"] for t in table], "array<string>"))
    held = once(keys, lambda h: F.filter(_fixed(table, f"array<struct<key:string,rules:{_RULE}>>"), lambda t: F.array_contains(h, t["key"])))
    return F.array_distinct(F.flatten(F.transform(held, lambda t: t["rules"])))


def _spans(pat: str, one: str, none: str, size) -> str:
    """SQL of what the matches of a pattern in _n give: `one` over x.v, and the places {start} and {end}, counted by size.
    Offsets are sums over what stands before, gathered FOLD matches at a time."""
    start, end = "a.at + x.gap", f"a.at + x.gap + {size('x.v')}"
    zipped = f"zip_with(transform(split(_n, {pat}, -1), t -> {size('t')}), regexp_extract_all(_n, {pat}, 0), (g, v) -> struct(g AS gap, v AS v))"
    inner = f"aggregate(ch, struct(acc.at AS at, {none} AS out), (a, x) -> CASE WHEN x.v IS NULL THEN a ELSE struct({end} AS at, concat(a.out, array({one.format(start=start, end=end)})) AS out) END)"
    outer = f"element_at(transform(array({inner}), r -> struct(r.at AS at, concat(acc.out, array(r.out)) AS out)), 1)"
    chunks = f"transform(sequence(0, (size(z) - 1) div {FOLD}), k -> slice(z, cast(k * {FOLD} + 1 as int), {FOLD}))"
    return f"element_at(transform(array({zipped}), z -> aggregate({chunks}, struct(0 AS at, filter(array({none}), q -> false) AS out), (acc, ch) -> {outer}, acc -> flatten(acc.out))), 1)"


def _phrase(label: str, words: str) -> str:
    """SQL of a base phrase's places, in words."""
    spans = _spans(f"'(?<= ){words}(?= )'", f"struct(5 AS p, '{label}' AS label, {{start}} - 1 AS w)", _BASE, lambda t: f"length({t}) - length(replace({t}, ' ', ''))")
    return f"CASE WHEN contains(_n, ' {words} ') THEN {spans} ELSE {_BASE} END"


def detect(docs: DataFrame, gated: bool = True) -> DataFrame:
    """doc_id, base columns, the kept detections and the score; without gates every rule is tried on every text."""
    low = F.translate(F.coalesce(F.col("text"), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    df = docs.select("doc_id", F.regexp_extract_all(low, F.lit(WORD), F.lit(0)).alias("_w"))
    df = df.select("doc_id", F.size("_w").cast("long").alias("n_words"), F.concat(F.lit(" "), F.array_join("_w", " "), F.lit(" ")).alias("_n"),
                   (fetched(F.col("_w")) if gated else _fixed([_rule(r) for r in rules()], _RULE)).alias("_r"))
    df = df.withColumn("_base", F.expr(f"concat({', '.join(_phrase(k, p) for k, p in BASE.items())})"))
    found = _spans("d.pat", f"struct({{start}} AS s, {{end}} AS e, CASE WHEN d.p > 0 THEN d.p ELSE {FORM_PRIORITY} END AS p, d.label AS label)", _DETS, lambda t: f"length({t})")
    df = df.withColumn("_rules", F.expr(f"flatten(transform(_r, d -> {found}))"))
    keyed = F.sort_array(F.transform("_rules", lambda d: F.struct(d["s"].alias("a"), (-d["e"]).alias("b"), (-d["p"]).alias("c"), d["label"].alias("d"), d.alias("x"))))
    far = F.array(*[F.lit(-1)] * 5)   # by priority, how far detections of at least that one reach

    def keep(m, k):
        d = k["x"]
        reach = F.transform(m, lambda v, i: F.when((i + 1 <= d["p"]) & (v < d["e"]), d["e"]).otherwise(v))
        inside = F.element_at(m, d["p"]) >= d["e"]
        return F.when(inside, m).otherwise(reach), F.when(inside, F.expr(_DETS)).otherwise(F.array(d))
    df = df.withColumn("_kept", F.when(F.size("_rules") > 0, folded(keyed, far, F.expr(_DETS), keep)).otherwise(F.expr(_DETS)))
    pos = F.transform("_base", lambda x: x["w"].cast("long"))
    labels = F.array_sort(F.array_union(F.array_distinct(F.transform("_base", lambda x: x["label"])), F.array_distinct(F.transform("_kept", lambda x: x["label"]))))
    score = F.aggregate(F.concat(F.transform("_base", lambda x: x["p"]), F.transform("_kept", lambda x: x["p"])), F.lit(0), lambda a, x: F.greatest(a, x)) / 5.0
    return df.select("doc_id", "n_words", F.size("_base").cast("long").alias("n_base"), F.array_min(pos).alias("first_word"), F.array_max(pos).alias("last_word"),
                     F.concat_ws(",", F.array_sort(F.array_distinct(F.transform("_base", lambda x: x["label"])))).alias("base_labels"),
                     F.concat_ws(",", labels).alias("labels"), score.cast("double").alias("score"), F.col("_kept").alias("detections"))


def report(docs: DataFrame) -> DataFrame:
    return detect(docs).drop("detections")
