"""Personal data in texts, by DataFrame functions only.

Base spans per kind are leftmost and non-overlapping; the possessive forms below match what the plain patterns match
without their backtracking. Added spans are secrets: two loose generators and one of issued formats propose overlapping
candidates, boosted trees over format and context score them, and a threshold selects; of overlapping selected spans the
leftmost longest stays. The trees learn to tell planted secrets, made from the texts' digests in several notations, from
planted names, paths, dates and numbers, made from the texts' words; notations of both that they have not learned from
set the threshold.

Null texts are empty; repeated rows keep their own result; without candidates only issued formats are added; texts and
values may be of any length; an empty table gives an empty result; extra columns stay as they are in `redact`."""
import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import quality
from .common import chunked, folded, once, piece

# fixed values: generators in the order of the report
KINDS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?+[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
PREFIXES = "AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|xox[abp]-[0-9A-Za-z-]{10,}"  # fixed value: formats of issued keys
GENERATORS = {  # fixed values: a named assignment, any run of key signs, and an issued key within letters' and digits' bounds
    "assigned": r"(?<![A-Za-z0-9_])[A-Za-z_]{2,24}+ ?[=:] ?[\x22\x27]?[A-Za-z0-9+/_-]{8,}+[\x22\x27]?",
    "run": r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}+",
    "issued": rf"(?<![A-Za-z0-9])(?:{PREFIXES})(?![A-Za-z0-9])",
}
NAMES = "token|passw(?:or)?d|secret|api_?key|access_?key|auth"  # fixed value: names of secrets
# fixed values: what stands before and after planted values, without and with a secret's name
FRAMES = [("", ""), ("value = '", "'"), ("id: ", ""), ("see ", "")]
NAMING = [("token = \"", "\""), ("api_key: ", ""), ("secret=", ""), ("the password is ", "")]
PRECISION = 0.95   # of what the threshold selects of the notations kept aside
BEFORE = 16        # characters before a candidate that its context features read
ALL = [*KINDS, "secret"]


def spans(text: Column, kind: str, pattern: str | None = None) -> Column:
    """array<struct<kind, start, end, value>>, code points, before validation."""
    pattern = pattern or KINDS[kind]
    parts, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    zipped = F.zip_with(F.transform(parts, F.length), found, lambda a, v: F.struct(a.alias("gap"), v.alias("v")))

    def step(at, x):
        s = at + x["gap"]
        e = s + F.coalesce(F.length(x["v"]), F.lit(0))
        one = F.struct(F.lit(kind).alias("kind"), s.alias("start"), e.alias("end"), x["v"].alias("value"))
        return e, F.when(x["v"].isNull(), F.expr(_EMPTY)).otherwise(F.array(one))
    return folded(zipped, F.lit(0), F.expr(_EMPTY), step)


def digits(v: Column) -> Column:
    return F.regexp_replace(v, "[^0-9]", "")


def luhn(v: Column) -> Column:
    ds = F.transform(F.split(F.reverse(digits(v)), ""), lambda c, i: F.when(i % 2 == 0, c.try_cast("int")).otherwise(
        F.when(c.try_cast("int") * 2 > 9, c.try_cast("int") * 2 - 9).otherwise(c.try_cast("int") * 2)))
    return F.aggregate(ds, F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0))) % 10 == 0


def valid(kind: str, v: Column) -> Column:
    n = F.length(digits(v))
    if kind == "ip":
        return F.forall(F.split(v, r"\."), lambda p: (F.length(F.regexp_replace(p, "^0+", "")) <= 3) & (F.coalesce(F.regexp_replace(p, "^0+", "").try_cast("int"), F.lit(0)) <= 255))
    if kind == "card":
        return n.between(13, 19) & F.when(n.between(13, 19), luhn(v)).otherwise(False)
    if kind == "phone":
        return n.between(9, 15)
    return F.lit(True)


GATES = {"email": lambda t: t.contains("@"), "phone": lambda t: t.contains("+"), "ip": lambda t: t.rlike("[0-9]"), "card": lambda t: t.rlike("[0-9]")}
_EMPTY = "cast(array() as array<struct<kind:string,start:int,end:int,value:string>>)"


def _checked(kind: str):
    return lambda s: valid(kind, s["value"])


def candidates(text: Column, generators: tuple = tuple(GENERATORS)) -> Column:
    """Overlapping candidates of the generators."""
    text = F.coalesce(text, F.lit(""))
    gates = {"assigned": text.rlike("[=:]"), "run": text.rlike("[A-Za-z0-9+/_-]{16}"), "issued": text.rlike("AKIA|gh[pousr]_|xox[abp]-")}
    return F.concat(*[F.when(gates[g], spans(text, "secret", GENERATORS[g])).otherwise(F.expr(_EMPTY)) for g in generators])


FEATURES = ["length", "digits", "uppers", "switches", "vowels", "classes", "quoted", "assigned", "hex", "named", "hinted", "signed"]


def features(value: Column, before: Column) -> list[Column]:
    """Small whole numbers, so that a corpus has few distinct feature rows. before: the text in front of the value."""
    key = F.regexp_extract(value, r"^([A-Za-z_]{2,24}) ?[=:]", 1)
    body = F.regexp_replace(F.regexp_replace(value, r"^[A-Za-z_]{2,24} ?[=:] ?", ""), r"[\x22\x27]", "")
    n = F.length(body)
    part = lambda p, k=8: F.floor(F.try_divide(F.length(F.regexp_replace(body, f"[^{p}]", "")) * k, n))
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("int")
    classes = flag(body.rlike("[a-z]")) + flag(body.rlike("[A-Z]")) + flag(body.rlike("[0-9]")) + flag(body.rlike("[+/_-]"))
    switches = F.floor(F.try_divide(F.size(F.regexp_extract_all(body, F.lit("[a-zA-Z][0-9]|[0-9][a-zA-Z]|[a-z][A-Z]"), F.lit(0))) * 8, n))
    cols = [F.least(F.floor(n / 8), F.lit(6)), part("0-9"), part("A-Z", 4), switches, part("aeiouAEIOU", 4), classes, flag(value.rlike(r"[\x22\x27]$")), flag(key != ""),
            flag(body.rlike("^[0-9a-fA-F]+$")), flag(key.rlike(f"(?i)^(?:{NAMES})$")), flag(before.rlike(f"(?i)(?:{NAMES})[^A-Za-z0-9]{{0,3}}(?:is )?$")), flag(before.rlike(r"[=:] ?[\x22\x27]?$"))]
    return [F.coalesce(c.cast("int"), F.lit(0)).alias(k) for c, k in zip(cols, FEATURES)]


def _before(chunks: Column, start: Column) -> Column:
    return piece(chunks, F.greatest(start - BEFORE, F.lit(0)), start)


def planted(docs: DataFrame) -> DataFrame:
    """Two made-up values for each text, with some text round them: text, secret and notation (0 to 4, 4 is kept aside).
    Secrets come from two digests of the text: hex digits of two lengths, base64, a mixture with signs, and groups of letters
    and digits. The others come from its words: joined names, paths, dates, long numbers, and paths with versions. Of the
    frames round secrets half name a secret, of the others one in eight."""
    one, two = F.sha2(F.col("text"), 256), F.base64(F.unhex(F.sha2(F.concat(F.col("text"), F.lit("#")), 256)))
    pick = lambda salt, n: F.pmod(F.xxhash64("text", F.lit(salt)), F.lit(n)).cast("int")
    groups = F.regexp_replace(F.concat_ws("-", *[F.substring(two, 1 + 6 * k, 6) for k in range(4)]), "[+/=]", "7")
    secret = F.array(F.substring(one, 1, 32), F.substring(one, 1, 40), F.regexp_replace(two, "=", ""), F.concat(F.substring(two, 1, 14), F.lit("_"), F.substring(one, 1, 12)), groups)
    words = F.filter(F.slice(F.split(F.substring("text", 1, 400), "[^A-Za-z]+"), 2, 12), lambda w: F.length(w) > 3)
    digit = lambda k, n: F.substring(F.translate(one, "abcdef", "012345"), k, n)
    joined = lambda sign, n: F.array_join(F.slice(words, 1, n), sign)
    other = F.array(F.lower(joined("_", 4)), joined("/", 4), F.concat(F.lit("20"), digit(1, 2), F.lit("-0"), digit(3, 1), F.lit("-1"), digit(4, 1), F.lit("_"), joined("-", 2)),
                    digit(5, 16), F.concat(joined("/", 2), digit(2, 1), F.lit("/v"), digit(6, 2), F.lit("/"), joined("_", 2)))

    def framed(value, naming, which):
        """naming: whether the frame names a secret."""
        plain, named = ([F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in fs] for fs in (FRAMES, NAMING))
        f = F.when(naming, F.element_at(F.array(*named), which)).otherwise(F.element_at(F.array(*plain), which))
        return F.concat(F.lit("and then "), f["a"], value, f["b"], F.lit(" as it stands"))
    both = F.array(F.struct(framed(F.element_at(secret, pick(2, 5) + 1), pick(7, 2) == 0, pick(8, 4) + 1).alias("text"), F.lit(1).alias("secret"), pick(2, 5).alias("notation")),
                   F.struct(framed(F.element_at(other, pick(3, 5) + 1), pick(4, 8) == 0, pick(5, 4) + 1).alias("text"), F.lit(0).alias("secret"), pick(3, 5).alias("notation")))
    return docs.select(F.explode(both).alias("x")).select("x.*")


def fit_boost(docs: DataFrame, rounds: int = 30) -> dict:
    """Trees over the loose candidates of planted values, counted by feature row (bounded by the features' few values). The
    threshold is the lowest score, at least a half, from which on PRECISION of the candidates of the notations kept aside
    are secrets. Issued keys are selected anyway."""
    made = planted(docs.select(F.coalesce(F.col("text"), F.lit("")).alias("text")))
    c = made.select("text", "secret", "notation", F.explode(candidates(F.col("text"), ("assigned", "run"))).alias("s"))
    rows = c.select("secret", "notation", *features(F.col("s.value"), _before(chunked(F.col("text")), F.col("s.start")))).groupBy("secret", "notation", *FEATURES).agg(F.count("*").alias("n")).collect()
    x = np.array([[float(r[k]) for k in FEATURES] for r in rows]).reshape(-1, len(FEATURES))
    n, y = np.array([float(r["n"]) for r in rows]), np.array([float(r["secret"]) for r in rows])
    aside = np.array([r["notation"] == 4 for r in rows], dtype=bool)
    if not (n * y)[~aside].sum() or not (n * (1 - y))[~aside].sum():
        return {"roots": [], "threshold": 2.0}
    mono = [int(k in ("named", "hinted")) for k in FEATURES]
    model = quality.fit_trees(x[~aside], y[~aside], rounds=rounds, depth=4, rate=0.3, weight=n[~aside], mono=mono, least=2)
    p = quality.predict(model, x)
    order = np.flatnonzero(aside)[np.argsort(-p[aside], kind="stable")]
    good = np.cumsum((n * y)[order]) / np.maximum(np.cumsum(n[order]), 1)
    fine = np.flatnonzero((good >= PRECISION) & (p[order] >= 0.5))
    model["threshold"] = float(p[order][fine[-1]]) - 1e-9 if len(fine) else 0.5
    over = aside & (p >= model["threshold"])
    model["precision_aside"], model["recall_aside"] = float((n * y)[over].sum() / max(n[over].sum(), 1)), float((n * y)[over].sum() / max((n * y)[aside].sum(), 1))
    return model


def boosted(model: dict, value: Column, before: Column) -> Column:
    """Probability of a candidate as an expression of nested conditions."""
    cols = features(value, before)
    def node(i: int, f) -> Column:
        j = int(model["feat"][i])
        if j < 0:
            return F.lit(float(model["val"][i]))
        k = int(model["left"][i])
        return F.when(f[FEATURES[j]] > float(model["thr"][i]), node(k + 1, f)).otherwise(node(k, f))
    def total(f) -> Column:
        z = F.lit(model["base"])
        for r in model["roots"]:
            z = z + node(r, f)
        return 1 / (1 + F.exp(-z))
    return F.element_at(F.transform(F.array(F.struct(*cols)), total), 1)


def select(model: dict, found: Column, text: Column) -> Column:
    """Candidates at or over the threshold and those of an issued format; leftmost longest of those that overlap."""
    issued = lambda s: s["value"].rlike(f"(?:^|[^A-Za-z0-9])(?:{PREFIXES})[\\x22\\x27]?$")
    fitted = bool(model["roots"]) and model["threshold"] <= 1
    over = lambda chunks: F.filter(found, lambda s: issued(s) | (boosted(model, s["value"], _before(chunks, s["start"])) >= model["threshold"]))
    kept = F.when(F.size(found) > 0, once(chunked(text), over)).otherwise(found) if fitted else F.filter(found, issued)

    def step(at, s):
        free = s["start"] >= at
        return F.when(free, s["end"]).otherwise(at), F.when(free, F.array(s)).otherwise(F.expr(_EMPTY))
    return folded(_ordered(kept), F.lit(0), F.expr(_EMPTY), step)


def _ordered(found: Column) -> Column:
    """By start, of equal ones the longest first."""
    keyed = F.sort_array(F.transform(found, lambda s: F.struct(s["start"].alias("a"), (-s["end"]).alias("b"), s.alias("s"))))
    return F.transform(keyed, lambda k: k["s"])


def _names(docs: DataFrame) -> dict:
    """Names of the added columns that no column of docs has."""
    return {k: next(n for n in (f"_pii{'_' * i}{k}" for i in range(1, 99)) if n not in docs.columns) for k in ALL}


def find(docs: DataFrame, model: dict | None = None) -> tuple[DataFrame, dict]:
    """docs with a column for each kind's validated spans, and these columns' names by kind; the trees are fitted on docs
    where no model is given."""
    model = model or fit_boost(docs)
    t = F.coalesce(F.col("text"), F.lit(""))
    out, names = docs, _names(docs)
    for k in KINDS:
        raw = F.when(GATES[k](t), spans(t, k)).otherwise(F.expr(_EMPTY))
        out = out.withColumn(names[k], F.filter(raw, _checked(k)))
    return out.withColumn(names["secret"], select(model, candidates(t), t)), names


def _joined(names: dict, kinds: list[str]) -> Column:
    return F.concat_ws(",", *[F.transform(names[k], lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))) for k in kinds])


def report(docs: DataFrame, model: dict | None = None) -> DataFrame:
    """doc_id, the counts, base_sha256 and spans."""
    base = ["email", "ip", "card", "phone"]
    df, names = find(docs.select("doc_id", "text"), model)
    return df.select("doc_id", *[F.size(names[k]).cast("long").alias(f"n_{k}") for k in base],
                     F.sha2(_joined(names, base), 256).alias("base_sha256"), _joined(names, [*base, "secret"]).alias("spans"))


def redact(docs: DataFrame, model: dict | None = None) -> DataFrame:
    """Replaces the found spans by their kind in brackets and sets n_chars where there is one; other columns stay."""
    df, names = find(docs, model)
    text = F.coalesce(F.col("text"), F.lit(""))
    every, texts = _ordered(F.concat(*[names[k] for k in ALL])), F.expr("cast(array() as array<string>)")

    def replaced(chunks: Column) -> Column:
        def step(at, s):
            put = F.concat(piece(chunks, at, s["start"]), F.lit("["), s["kind"], F.lit("]"))
            return F.greatest(at, s["end"]), F.when(s["start"] >= at, F.array(put)).otherwise(texts)
        last = F.aggregate(every, F.lit(0), lambda at, s: F.greatest(at, s["end"]))
        return F.concat(F.concat_ws("", folded(every, F.lit(0), texts, step)), piece(chunks, last, F.length(text)))
    df = df.withColumn("text", F.when(F.size(every) > 0, once(chunked(text), replaced)).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        df = df.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return df.select(*docs.columns)
