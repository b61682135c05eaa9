"""Decoding of character lattices against all paths, on short tokens and random models; time on long tokens."""
import itertools
import random
import time

import numpy as np
import pytest

from pluvia.llm import toxicity
from pluvia.llm.toxicity import COSTS, LEET, LETTERS


def every_path(token, lm, end):
    """(log10 probability, restored letters) of all readings, none left out."""
    found = []

    def go(i, a, b, p, out, run):
        if i == len(token):
            found.append((p + lm[a][b][26], out))
            return
        c, before = token[i], token[i - 1] if i else ""
        run = run + 1 if c == before else 1
        outs, cost = (c, 0.0) if c in LETTERS else (LEET.get(c, ""), COSTS["star"] if c == "*" else COSTS["leet"])
        for o in outs:
            k = ord(o) - 97
            go(i + 1, b, k, p + lm[a][b][k] - cost, out + o, run)
            if b != 26:
                go(i + 1, 26, k, p + lm[a][b][26] - end + lm[26][26][k] - cost, f"{out} {o}", run)
        if not out and not outs:   # separators before the first letter
            go(i + 1, a, b, p, out, run)
        elif out and (not outs or c == "*"):
            go(i + 1, a, b, p - COSTS["lost" if c == "*" else "drop"], out, run)
        elif out and out[-1] in outs and (out[-1] == before or out[-1] in LEET.get(before, "")):
            go(i + 1, a, b, p - COSTS["run" if run > 2 or c * 3 in token else "double"], out, run)
    go(0, 26, 26, 0.0, "", 0)
    return found


@pytest.mark.parametrize("seed", range(6))
def test_decoding_is_the_best_of_all_paths(seed):
    rnd, gen = random.Random(seed), np.random.default_rng(seed)
    lm = np.log10(gen.dirichlet(np.full(27, 0.2), size=(27, 27)) + 1e-9).tolist()
    tokens = ["".join(rnd.choice("ab1*.3$|lles!") for _ in range(rnd.randint(1, 6))) for _ in range(150)]
    tokens += ["".join(t) for t in itertools.product("l1*.", repeat=3)] + ["***", "lll1", "*" * 5, "|1|1|"]
    for t in tokens:
        for end in (0.0, 1.0):
            paths = every_path(t, lm, end)
            got = toxicity.viterbi(t, toxicity.rows(np.array(lm)), end)
            full = [(p, out) for p, out in paths if out]
            if not full:
                assert got == t
                continue
            best = max(p for p, _ in paths)
            assert any(out == got and p >= best - 1e-9 for p, out in full), (t, end, got)


def test_long_tokens_end_in_time():
    lm = toxicity.log_model(toxicity.trigrams([b"idiot", b"stupid", b"kill"]))
    start = time.time()
    assert len(toxicity.viterbi("k1ll.1d10t*" * 9_000, toxicity.rows(lm), COSTS["glued"])) > 9_000
    assert time.time() - start < 60
