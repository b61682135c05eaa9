"""Training-corpus pipeline: quality, near duplicates, decontamination, personal data, mixing."""
from pluvia.llm import decontaminate, minhash, mixing, pii, quality
from pluvia.sources.scratch import folder


def _table(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


def keep_quality(spark, docs, d):
    """Quality rules: rows that the base rule or the trees reject go."""
    return quality.filter_kept(docs, quality.fit(docs, _table(spark, d, "labels")))


def keep_one_copy(spark, docs, d):
    """Near duplicates by five-word shingles at a similarity of 0.8: one row of each group stays, rows without an id too."""
    return minhash.keep_one(docs)


def keep_uncontaminated(spark, docs, d):
    """Rows with a verified benchmark passage go."""
    return decontaminate.clean(docs, _table(spark, d, "benchmark"))


def redact_personal_data(spark, docs, d):
    """Spans of personal data and secrets are replaced by their kind; every row stays."""
    return pii.redact(docs)


def mix(spark, docs, d):
    """Every row stays, with its tokens, domain probabilities and rate."""
    return mixing.rates(docs, _table(spark, d, "labels"), texts=True)


STAGES = [("quality", keep_quality), ("near_duplicates", keep_one_copy), ("decontamination", keep_uncontaminated), ("pii", redact_personal_data), ("mixing", mix)]
ORACLE_SQL = None  # fitted stages; tests/llm/test_pipeline.py holds the near duplicates and run() against brute force


def run(spark, sf_dir):
    """The stages in their order on all documents, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        out = folder(spark, name)
        stage(spark, docs, sf_dir).write.parquet(out)
        docs = spark.read.parquet(out)
    return docs
