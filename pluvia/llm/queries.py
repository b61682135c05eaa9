"""Registered queries of the training-data operators."""
import public_tokenizers

from . import decontaminate, fim, license, lm, mixing, pii, quality, search, simhash, substrings, tokens, toxicity, urls
from .common import documents


def labels(s, d):
    return s.read.parquet(f"{d}/labels.parquet")


def benchmark(s, d):
    return s.read.parquet(f"{d}/benchmark.parquet")


SQL = {"op11_lexical_search": search.SQL, "op12_fill_in_middle": fim.SQL, "op13_url_filter": urls.SQL}
Q = {
    "op1_simhash_dedup": lambda s, d: simhash.near_duplicates(documents(s, d)),
    "op2_license": lambda s, d: license.report(documents(s, d)),
    "op3_toxicity": lambda s, d: toxicity.toxicity(documents(s, d), labels(s, d)),
    "op4_decontaminate": lambda s, d: decontaminate.pairs(documents(s, d), benchmark(s, d)),
    "op5_substrings": lambda s, d: substrings.dedup(documents(s, d)),
    "op6_quality": lambda s, d: quality.score(documents(s, d), quality.fit(documents(s, d), labels(s, d))),
    "op7_mixing": lambda s, d: mixing.rates(documents(s, d).select("doc_id", "source", "text"), labels(s, d)),
    "op8_lm_score": lambda s, d: lm.scores(documents(s, d)),
    "op9_pii": lambda s, d: pii.report(documents(s, d)),
    "op10_token_counts": lambda s, d: tokens.token_counts(documents(s, d), public_tokenizers.path("word_bpe_49k.json")),
    "op11_lexical_search": lambda s, d: search.search(documents(s, d), benchmark(s, d)),
    "op12_fill_in_middle": lambda s, d: fim.report(documents(s, d)),
    "op13_url_filter": lambda s, d: urls.judge(s.read.parquet(f"{d}/pages.parquet").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict"),
}


def _pipeline(s, d):
    import corpus_pipeline
    return corpus_pipeline.run(s, d)


Q["pipeline"] = _pipeline
