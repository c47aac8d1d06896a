import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from mendery.llm import langid, quality
from mendery.llm.common import crc_remainder, read
from test_jaccard_join import brute
from test_packing import whole

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    docs = read(spark, SF, "documents")
    kept = docs
    stages = dict(corpus_pipeline.STAGES)
    # language: as the operator's own scores say
    model = langid.train_on(docs.filter(crc_remainder("doc_id", 3) != 1))
    ids = {r.doc_id for r in langid.identify(docs, model).collect() if r.lang_pred != "und" and r.score >= corpus_pipeline.LEAST_SHARE}
    kept = stages["language identification"](spark, docs, SF)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == ids
    # quality
    kept = stages["quality classifier"](spark, docs, SF)
    assert kept.columns == docs.columns
    good = quality.train_on(docs, read(spark, SF, "labels").filter(crc_remainder("doc_id", 5) != 0))
    want = {r.doc_id for r in quality.score_documents(docs, good).collect() if r.score >= quality.THRESHOLD}
    assert {r.doc_id for r in kept.collect()} == want and 0 < len(want) < docs.count()
    # near duplicates: the smallest id of each component
    kept = stages["n-gram Jaccard join"](spark, docs, SF)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = {int(d) for d, _, c in brute(rows, 5, 80) if d == c}
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == want and len(want) < len(rows)


def test_run(spark):
    rows = corpus_pipeline.run(spark, SF).collect()
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = {r.doc_id: r.text for r in read(spark, SF, "documents").collect()}
    size = {}
    for r in rows:
        size[r.doc_id] = size.get(r.doc_id, 0) + r.length
    assert all(n == len(tok.encode(texts[d], add_special_tokens=False).ids) + 1 for d, n in size.items())
    assert whole(rows, 1024) <= len(rows) and 0.4 * len(texts) < len(size) < len(texts)


def test_odd_rows_pass_the_stages(spark):
    en = "the river runs past the old mill and on to the sea while people walk there in the evening. "
    data = [(1, en, "en", "s", 1), (1, en, "en", "s", 1), (2, en.upper(), None, None, None), (None, en, None, None, None), (None, en + "x", None, None, None), (5, None, None, None, None), (6, "", None, None, None), (7, "12 34", None, None, None)]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long")
    out = corpus_pipeline.near_duplicates(spark, docs, SF)
    assert sorted((r.doc_id for r in out.collect()), key=str) == [1, 5, 6, 7]
    assert {r.doc_id for r in corpus_pipeline.language(spark, docs, SF).collect()} <= {1, 2, None}
    assert corpus_pipeline.good_quality(spark, docs, SF).count() <= len(data)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), SF).count() == 0


def test_foreign_and_junk_texts_go(spark):
    docs = read(spark, SF, "documents")
    foreign = ["Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. " * 5, "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. " * 5, "Все люди рождаются свободными и равными в своем достоинстве и правах. " * 5, "xq zvkw qqj wpxz kjhg fdsz qwrt zxcv plmk njhb vgfc " * 5, "zzzz"]
    odd = spark.createDataFrame([(-1 - i, x, None, None, None) for i, x in enumerate(foreign)], docs.schema)
    kept = {r.doc_id for r in corpus_pipeline.language(spark, docs.unionByName(odd), SF).collect()}
    assert kept == {r.doc_id for r in docs.collect()}
    # the fewer languages, the more a share alone lets through: a language left out goes all the same
    for lang, least in (("de", 0.9), ("fr", 0.9)):
        model = langid.train_on(docs.filter(F.col("lang") != lang))
        left_out = docs.filter(F.col("lang") == lang)
        assert langid.keep_identified(left_out, model, corpus_pipeline.LEAST_SHARE, corpus_pipeline.LEAST_KNOWN).count() <= (1 - least) * left_out.count()


def test_one_id_on_several_texts(spark):
    near = [" ".join(f"w{i}" for i in range(200)) + f" end{k}" for k in range(4)]
    lone = " ".join(f"v{i}" for i in range(100))
    data = [(3, near[0]), (5, near[1]), (5, lone), (9, "other words that nothing else has at all"), (9, "still more words that link with nothing")]
    docs = spark.createDataFrame(data, "doc_id long, text string")
    kept = {(r.doc_id, r.text) for r in corpus_pipeline.near_duplicates(spark, docs, SF).collect()}
    assert kept == {x for x in data if x != (5, near[1])}
    # two near copies under the smallest id leave one
    docs = spark.createDataFrame([(1, near[2]), (1, near[3]), (4, near[0])], "doc_id long, text string")
    kept = [r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, SF).collect()]
    assert kept == [1]
