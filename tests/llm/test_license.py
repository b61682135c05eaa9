"""License rules: wanted labels, keywords, contexts, and detections against plain Python."""
import re

import regex

from pluvia.llm import license
from pluvia.llm.license_rules import SIGNATURES

#: text and the labels of the method with those of the base
EXAMPLES = [
    ("GNU GPLv3", "gpl"), ("GPL-3.0-or-later", "gpl"), ("BSD-3-Clause", "bsd"), ("LGPL", "lgpl"), ("AGPL-3.0-only", "agpl"), ("Apache-2.0", "apache"),
    ("SPDX-License-Identifier: GPL-2.0 OR MIT", "gpl,mit"), ("SPDX-License-Identifier: (Apache-2.0 OR MIT) AND ISC", "apache,isc,mit"), ("SPDX-License-Identifier: MIT", "mit"),
    ("SPDX-License-Identifier: GPL-2.0-only WITH Linux-syscall-note OR BSD-3-Clause OR Zlib", "bsd,gpl,gpl-exception,zlib"),
    ("GNU Lesser General Public License", "gpl,lgpl"), ("GNU Affero General Public License", "agpl,gpl"), ("GNU General Public License", "gnu-gpl,gpl"),
    ("The Software shall be used for Good, not Evil.", "json"), ("under the same terms as Perl itself", "perl"), ("Server Side Public License", "sspl"),
    ("Business Source License 1.1", "business-source"), ("CC BY-NC-SA 4.0", "cc-by,cc-sa"), ("CC0-1.0", "cc0"), ("https://creativecommons.org/licenses/by-nc/4.0/", "cc"),
    ("the 2-clause and the Two-Clause BSD license", "bsd"), ("for research purposes only", "research"), ("Some Rights Reserved", "some-rights"), ("Mulan PSL: MulanPSL-2.0", "mulan"),
    ("Permission is hereby granted without stillborn conditions", "mit-modern"), ("BigScience RAIL license", "rail"), ("a work of the United States government", "public-domain"),
    # other meanings
    ("this ruby license plate", ""), ("the mit license office", ""), ("a python license server and the php license key", ""), ("limits under way", ""), ("an isc and a vim and mit", ""),
    ("the spdx license identifier is missing; students of mit and isc wrote it", ""), ("a public domain", ""), ("LICENSE", ""), ("", ""), (None, ""),
]


def brute(text):
    words = re.findall("[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
    n, found = f" {' '.join(words)} ", []
    for r in license.rules():
        for m in regex.finditer(r["pat"], n):
            v = m[0]
            form = 4 if re.match("(?:licensed|released|distributed|available) under |spdx ", v) else 3 if v.startswith("this work is ") else 2 if re.search(" licen[sc]e", v) else 1
            found.append((m.start(), m.end(), r["p"] or form, r["label"]))
    kept = []
    for d in sorted(found, key=lambda d: (d[0], -d[1], -d[2], d[3])):
        if not any(k[1] >= d[1] and k[2] >= d[2] for k in kept):
            kept.append(d)
    return kept


def test_examples_equal_plain_python(spark):
    texts = [t for t, _ in EXAMPLES] + ["\n".join(t or "" for t, _ in EXAMPLES), "é GPL ñ MIT License ß", "MIT License " * 3 + "x" * 200_000]
    d = spark.createDataFrame([(i, t, "a") for i, t in enumerate(texts)], "doc_id long, text string, _w string")
    got = {r.doc_id: r for r in license.detect(d).collect()}
    assert [(t, got[i].labels) for i, (t, _) in enumerate(EXAMPLES)] == EXAMPLES
    for i, t in enumerate(texts):
        assert [tuple(x) for x in got[i].detections] == brute(t), t
    assert sorted(map(str, got.values())) == sorted(map(str, license.detect(d, gated=False).collect()))


def test_every_signature_is_its_own_and_holds_its_keyword():
    assert len(SIGNATURES) >= 200 and len({p for *_, p in SIGNATURES}) >= 200
    for _, p, keys, pat in SIGNATURES:
        assert 1 <= p <= 4
        for alternative in ([pat] if pat.startswith("(") or "(" in pat else pat.split("|")):
            assert any(regex.search(rf"\b{k[:-1]}", alternative) for k in keys.split()), pat


def test_documents_equal_plain_python(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    for r in license.detect(docs).collect():
        assert [tuple(x) for x in r.detections] == brute(texts[r.doc_id])
