import random

import pytest

from quartzbar.llm.encoding import LONG_WORD, Encoder, contract_by_heap, encode_corpus
from quartzbar.llm.tokenizers import FOLDER, counter

tokenizers = pytest.importorskip("tokenizers")

TEXTS = [
    "Hello, world! It's 12:30  \n\n and  we've 3 bars.", "", None, "   ", "\n", "<|endoftext|> is text", "资金费率升至44.6060%！？", "ตรวจสอบซ้ำ ๆ จนกว่าข้อมูลจะครบ",
    "أُلغي الأمر f2eb06c4", "👩‍🔧 lane ​ x́", "\x00\x7f\u0080￿", "a" * 3000, "ab" * 900 + " tail", "\t\ttabs\r\nand　blanks", "naïve café — «déjà»",
]


@pytest.fixture(scope="module")
def reference():
    t = tokenizers.Tokenizer.from_file(f"{FOLDER}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    return lambda text: t.encode(text, add_special_tokens=False).ids if text else []


@pytest.fixture(scope="module")
def encoder():
    return Encoder("byte_bpe_50k", FOLDER)


def test_equal_to_the_library(encoder, reference):
    assert encoder.encode(TEXTS).to_pylist() == [reference(t) for t in TEXTS]


def test_random_texts_and_a_full_cache(encoder, reference, monkeypatch):
    rng = random.Random(3)
    alphabet = "abcdefgh ABC.,'’0123\nßéж中文ก्👍"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(200))) for _ in range(300)]
    monkeypatch.setattr("quartzbar.llm.encoding.CACHE_WORDS", 50)
    for i in range(0, 300, 60):
        assert encoder.encode(texts[i : i + 60]).to_pylist() == [reference(t) for t in texts[i : i + 60]]


def test_recursion_and_heap_agree(encoder, reference):
    rng = random.Random(5)
    for n in (1, 2, 5, 40, 400):
        word = "".join(rng.choice("abcdetion") for _ in range(n))
        heap = contract_by_heap([encoder.bytes[b] for b in word.encode()], encoder.ranks)
        assert heap == encoder.encode([word]).to_pylist()[0] == reference(word)


@pytest.mark.parametrize("word", ["a" * n for n in range(1, 40)] + ["ab" * 300, "aab" * 200, "ha" * 999, "---" * 500, "=" * 4096, "ааа" * 700])
def test_repetitions(encoder, reference, word):
    assert encoder.encode([word, None, word + word[:1]]).to_pylist() == [reference(word), [], reference(word + word[:1])]


def test_merges_of_a_made_token_have_higher_ranks(encoder):
    made = {c: k for k, c in encoder.ranks.values()}
    assert all(made.get(t, -1) < k for pair, (k, _) in encoder.ranks.items() for t in pair)


def test_very_long_word(encoder, reference):
    word = "".join(random.Random(1).choice("abcdefghijklmnopqrst") for _ in range(60_000))
    assert len(word) > LONG_WORD and encoder.encode([word]).to_pylist()[0] == reference(word)


def test_table(spark, reference):
    rows = [(i, t, ["clash"]) for i, t in enumerate(TEXTS)] + [(None, "null id", None), (0, TEXTS[0], None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids array<string>")
    got = sorted(((r.doc_id if r.doc_id is not None else -1), list(r.ids)) for r in encode_corpus(df).collect())
    assert got == sorted((i if i is not None else -1, reference(t)) for i, t, _ in rows)
    assert encode_corpus(df.limit(0)).count() == 0
    assert dict(encode_corpus(df).dtypes) == {"doc_id": "bigint", "ids": "array<int>"}


@pytest.mark.parametrize("name", ["byte_bpe_50k", "piece_bpe_32k", "word_bpe_49k"])
def test_counters(name, reference):
    count = counter(name, FOLDER)
    texts = [t or "" for t in TEXTS]
    texts += ["  a  b ", "a ", " ", "   ", "\n x ", "▁a ▁ b", "x\u0378y \U0001fae9 z", "J̌ J̌k", "İstanbul ΣΑΣ Σ", "a\x1cb\x1f c", "a\tb\u3000c\u00a0d", "<s> </s> <unk>"]
    got = count(texts)
    assert len(got) == len(texts) and got[1] == 0 and got[0] > 0
    if name == "piece_bpe_32k":
        library = pytest.importorskip("sentencepiece").SentencePieceProcessor(model_file=f"{FOLDER}/{name}.model")
        assert got == [len(library.encode(t)) for t in texts]
    if name == "word_bpe_49k":
        library = tokenizers.Tokenizer.from_file(f"{FOLDER}/{name}.json")
        library.encode_special_tokens = True
        assert got == [len(library.encode(t, add_special_tokens=False).ids) for t in texts]
    if name == "byte_bpe_50k":
        assert got == [len(reference(t)) for t in texts]
