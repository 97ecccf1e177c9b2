import random

import public_tokenizers
from tokenizers import Tokenizer

from tidemark.llm import tokens

PATH = str(public_tokenizers.path("word_bpe_49k.json"))
FIXED = [
    "", " ", "a", "It's we'll I'D they've", "****** !!!!!! aaaaaaaaaaaaaaaaaaaaa", "abcabc" * 3000, "…" * 5000, "Ünïcödé ñandú ÀÉÎ İstanbul ΣΑΣ ΟΔΟΣ",
    "<|endoftext|>", "a<|endoftext|>b <|startoftext|><|startoftext|>", "<|EndOfText|>", "12345 3.14 ½ ²", "東京タワー ไทย हिन्दी 한국어",
    "ẛ̣ é ﬁ", "a b c\u0085d\x1ce​f", "\U0001f600\U0001f468‍\U0001f469", "tab\tnew\nline\r\n", "ǅ ß ẞ Ⅷ",
]


def test_counts_match_the_library():
    rng = random.Random(3)
    pool = "abcdefghij AEIOU'stredm.,!?*#  \n\tñéüßçΣσİ東京①½٣́‍\U0001f600"
    texts = FIXED + ["".join(rng.choice(pool) for _ in range(rng.randrange(1, 200))) for _ in range(400)]
    library = Tokenizer.from_file(PATH)
    expected = [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]
    assert tokens.Counter(tokens.MergeTable(PATH)).counts(texts) == expected


def test_every_code_point():
    points = [chr(c) for c in range(1, 0x20000) if not 0xD800 <= c < 0xE000]
    texts = points + [f"a{c}B" for c in points]
    library = Tokenizer.from_file(PATH)
    counter = tokens.Counter(tokens.MergeTable(PATH))
    differ = [t for t, e, n in zip(texts, library.encode_batch(texts, add_special_tokens=False), counter.counts(texts), strict=True) if len(e.ids) != n]
    assert differ == []


def test_whole_table_and_edge_rows(spark):
    rows = [(1, "one two", "x"), (None, None, "y"), (2, "", None), (2, "", None), (3, "long word " * 30_000, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    got = sorted((tuple(r) for r in tokens.token_counts(docs, PATH).collect()), key=str)
    assert got == sorted([(1, 7, 2, False), (None, 0, 0, False), (2, 0, 0, False), (2, 0, 0, False), (3, 300_000, 60_000, True)], key=str)
    assert tokens.token_counts(docs.limit(0), PATH).count() == 0


def test_documents(spark, sf_dir):
    from tidemark.llm.queries import op7_token_counts

    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    library = Tokenizer.from_file(PATH)
    for r in op7_token_counts(spark, sf_dir).collect():
        n = len(library.encode(texts[r["doc_id"]], add_special_tokens=False).ids)
        assert (r["n_tokens"], r["n_bytes"], r["over_limit"]) == (n, len(texts[r["doc_id"]].encode()), n > 2048)
