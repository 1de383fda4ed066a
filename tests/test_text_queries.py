"""Registered queries without SQL, whole, on small fixtures."""

from collections import Counter

from vellumlake import catalog
from vellumlake.functions.lexer import conserved_tokens


def test_conserved_tokens_full_reads_every_numeral(spark, tmp_path):
    texts = ["百分之百\n没有", "百分之零", "千分之两", "万分之〇\n亿分之千", "约3万人", "三分之二"]
    spark.createDataFrame([(i, t, "zh") for i, t in enumerate(texts)], "doc_id bigint, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    want = Counter(t for text in texts for line in text.split("\n") for t in conserved_tokens(line))
    got = {r.token: r.n for r in catalog.QUERIES["conserved_tokens_full"](spark, str(tmp_path)).collect()}
    assert got == want and got["1/1"] == 1 and got["0/1"] == 2
