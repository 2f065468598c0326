"""The registered queries over whole small tables: against SQL where there is any, else as contracts."""

import math
import re
import unicodedata
from collections import Counter

import oracle
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from skeinflow.llm import byte_bpe, jaccard_join, language_id, quality_rules, queries

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, name):
    assert oracle.difference(queries.queries()[name](spark, SMALL), oracle.connect(SMALL), queries.oracle_sql()[name]) == ""


@pytest.mark.parametrize("name", sorted(set(queries.queries()) - set(queries.oracle_sql()) - {"op11_ann_partitions"}))  # which test_ann_partitions compares
def test_query_covers_its_table(spark, name):
    table = "pages" if name.startswith("op7") else "documents"
    assert queries.queries()[name](spark, SMALL).count() == spark.read.parquet(f"{SMALL}/{table}.parquet").count()


def test_languages_of_held_out_documents(spark):
    found = queries.op8_language_id(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), "doc_id").where("held_out and lang is not null")
    assert found.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.98


CLASHES = ["n_words", "score", "_t", "_rest", "row", "lang_pred", "cls", "stays", "n_hit", "ids", "kept", "lang_rejected", "component_id"]


def test_pipeline_keeps_columns_of_any_name(spark):
    """All rows, null ids, texts and labels and repeated rows among them, with columns named like the stages'
    own: what stays has its columns unchanged."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    more = docs.limit(5).withColumn("doc_id", F.lit(None).cast("long")).unionByName(docs.limit(5).withColumn("text", F.lit(None).cast("string"))).unionByName(docs.limit(5)).unionByName(docs.limit(5).withColumn("lang", F.lit(None).cast("string")))
    docs = docs.unionByName(more).withColumns({c: F.concat(F.lit(f"{c} "), F.coalesce(F.col("doc_id").cast("string"), F.lit("?"))) for c in CLASHES})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, SMALL)
        assert kept.columns == docs.columns, name
        docs = jaccard_join.materialize(kept)
        assert docs.where(" or ".join(f"`{c}` <> concat('{c} ', coalesce(cast(doc_id as string), '?'))" for c in CLASHES)).count() == 0, name
    assert docs.where("text is null").count() == 0 < docs.count()
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SMALL).columns == ["doc_id", "n_tokens", "ids"]


def plain_stages(docs, benchmark):
    """The pipeline on lists of (doc_id, text, lang), in plain Python but for the two fitted models."""
    fold = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    words_of = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t or "")

    def base_failed(words):
        grams = [tuple(words[k : k + 5]) for k in range(len(words) - 4)]
        counts = Counter(grams)
        covered = {k + j for k, g in enumerate(grams) if counts[g] > 1 for j in range(5)}
        return len(words) < 10 or 100 * len(covered) > 20 * len(words)

    def histograms(text, words, common):
        of = lambda p: len(re.findall(p, text))
        upper, digit = sum(unicodedata.category(c) == "Lu" for c in text), sum(unicodedata.category(c) == "Nd" for c in text)
        classes = [upper, digit, of(r"[#*$%&|<>]"), of(r"[.,;:?'()\x22-]"), of(r"[\x20\x09-\x0D]")]
        seen = [words.count(w) for w in common]
        return [*classes, len(text) - sum(classes)], [*seen, len(words) - sum(seen)]

    def distance(p, q):
        p, q = ([x / sum(h) for x in h] for h in (p, q))
        terms = [x * math.log2(2 * x / (x + y)) for a, b in ((p, q), (q, p)) for x, y in zip(a, b, strict=True) if x]
        return math.sqrt(max(0, sum(terms) / 2))

    config = quality_rules.QualityConfig()
    rows = [(d, t, lang, words_of(t)) for d, t, lang in docs]
    long = [r for r in rows if r[2] and len(r[3]) >= config.min_words]
    common = set()
    for lang in {r[2] for r in long}:
        counts = Counter(w for r in long if r[2] == lang for w in set(r[3]))
        common |= {w for w, _ in sorted(counts.items(), key=lambda x: (-x[1], x[0].encode()))[: config.common]}
    common = sorted(common)
    refs = {}
    for _, t, lang, words in long:
        if not base_failed(words):
            refs.setdefault(lang, []).append(histograms(t, words, common))
    refs = [[[sum(x) for x in zip(*[h[i] for h in hs], strict=True)] for i in (0, 1)] for hs in refs.values()]

    def kept(t, words):
        if base_failed(words) or len(words) < config.min_words:
            return not base_failed(words)
        noise = config.slack / math.sqrt(len(words))
        c, w = histograms(t, words, common)
        return any(distance(c, a) <= config.max_class_distance + noise and distance(w, b) <= config.max_word_distance + noise for a, b in refs)

    yield (rows := [r for r in rows if kept(r[1], r[3])])
    model = yield
    rows = [r for r in rows if not language_id.predict(model, r[1])[2]]
    yield rows
    sets = []
    for r in rows:
        w = [x.translate(fold) for x in r[3]]
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} or {tuple(w)})
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if 3 * len(a) <= 4 * len(sets[j]) and 3 * len(sets[j]) <= 4 * len(a) and 100 * len(a & sets[j]) >= 75 * len(a | sets[j]):
                x, y = find(i), find(j)
                root[max(x, y, key=lambda k: rows[k][0])] = min(x, y, key=lambda k: rows[k][0])
    rows = [r for i, r in enumerate(rows) if find(i) == i]
    yield rows
    terms = lambda t: re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(fold).encode())
    windows = set()
    for t in benchmark:
        w = terms(t)
        windows |= {tuple(w[i : i + min(10, len(w))]) for i in range(max(1, len(w) - 9))} if w else set()
    sizes = {len(w) for w in windows}
    yield [r for r in rows if not any(tuple(w[i : i + k]) in windows for w in [terms(r[1])] for k in sizes for i in range(len(w) - k + 1))]


def test_pipeline_equals_plain_python(spark):
    table = spark.read.parquet(f"{SMALL}/documents.parquet")
    docs = [(r["doc_id"], r["text"], r["lang"]) for r in table.collect()]
    stages = plain_stages(docs, [r["text"] for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()])
    ids = lambda rows: sorted(r[0] for r in rows)
    now, found = table, []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        now = jaccard_join.materialize(stage(spark, now, SMALL))
        found.append(now)
    expected = [ids(next(stages))]
    next(stages)
    kept = found[0]
    expected.append(ids(stages.send(language_id.train(kept.where(~language_id.held_out())))))
    expected += [ids(next(stages)), ids(next(stages))]
    assert [sorted(r["doc_id"] for r in df.select("doc_id").collect()) for df in found] == expected
    out = {r["doc_id"]: r["ids"] for r in corpus_pipeline.run(spark, SMALL).collect()}
    assert sorted(out) == expected[-1] and 0 < len(out) < len(docs)
    plain = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), special_tokens={})
    assert all(out[d] == plain.encode_ordinary(t) for d, t, _ in docs if d in out)


def test_pipeline_of_an_empty_table(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SMALL)
    assert docs.count() == 0
