"""Fill-in-the-middle order of texts by one match with repeated captures.

A single fullmatch of (unit)* keeps the end of every repetition, so its ends give the number of units and, by index, both
places where the text is cut; nothing is iterated. Cuts and form follow from a digest of the seed and doc_id alone.

A null text is an empty one; empty texts, and texts that hold one of the signs, stay as they are (`plain`); a null doc_id
counts as one without digits; repeated rows give equal results; texts may be of any length (about 0.3 microseconds a
character); an empty table gives an empty result; other columns stay, those named like an added one are replaced."""
import hashlib

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

# fixed values
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
UNITS = regex.compile(r"([\x20\x09-\x0D]*+[^\x20\x09-\x0D]++|[\x20\x09-\x0D]++)*+")
ADDED = "n long, form string, prefix_chars long, middle_chars long, output string"


def draws(seed: int, doc_id: int | None) -> list[int]:
    """Four numbers of 32 bits."""
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(h[k:k + 8], 16) for k in (0, 8, 16, 24)]


def arrange(text: str, h: list[int], rate: int, spm: int) -> tuple:
    """n, form, prefix_chars, middle_chars and the output."""
    ends = UNITS.fullmatch(text).ends(1)
    n = len(ends)
    if not text or h[2] % 100 >= rate or any(s in text for s in (PREFIX, SUFFIX, MIDDLE)):
        return n, "plain", None, None, text
    a, b = (0 if k == 0 else ends[k - 1] for k in sorted((h[0] % (n + 1), h[1] % (n + 1))))
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h[3] % 100 < spm:
        return n, "spm", a, b - a, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return n, "psm", a, b - a, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def transform(docs: DataFrame, seed: int = 42, rate: int = 50, spm: int = 80) -> DataFrame:
    """docs (doc_id, text, ...) with n, form, prefix_chars, middle_chars and output instead of text: of 100 texts about `rate`
    are cut, of 100 of these about `spm` get the suffix first."""
    new = StructType.fromDDL(ADDED)
    kept = [f for f in docs.schema if f.name != "text" and f.name not in new.names]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]
    names = [f.name for f in kept] + new.names

    def run(batches):
        for b in batches:
            rows = zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist())
            got = [arrange(t or "", draws(seed, i), rate, spm) for i, t in rows]
            own = [pa.array([r[k] for r in got], type=t) for k, t in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([b.column(f.name) for f in kept] + own, names)
    return docs.mapInArrow(run, StructType(kept + list(new)))


def restored(output: Column, form: Column) -> Column:
    """The exact text: no sign stands in the parts, so the output is split at them."""
    p = F.split(output, "<[PSM]>", -1)
    return F.when(form == "psm", F.concat(p[1], p[3], p[2])).when(form == "spm", F.concat(p[2], p[3], p[1])).otherwise(output)


def report(docs: DataFrame, seed: int = 42, rate: int = 50, spm: int = 80) -> DataFrame:
    """Sizes and form of each text, and digests of its output and of the text that is rebuilt from it."""
    rows = transform(docs.select("doc_id", "text"), seed, rate, spm)
    digest = [F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256")]
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digest)


SQL = """WITH s AS (SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
u AS (SELECT doc_id, t, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2, CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4,
 regexp_extract_all(t, '[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+') AS l FROM s),
c AS (SELECT doc_id, t, l, CAST(len(l) AS BIGINT) AS n, least(h1 % (len(l)+1), h2 % (len(l)+1)) AS a, greatest(h1 % (len(l)+1), h2 % (len(l)+1)) AS b,
 CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (SELECT *, array_to_string(l[1:a], '') AS pre, array_to_string(l[a+1:b], '') AS mid, array_to_string(l[b+1:], '') AS suf FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(pre) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(mid) AS BIGINT) END AS middle_chars,
 sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
 sha256(pre || mid || suf) AS restored_sha256 FROM p"""
