import random

from tokenizers import Tokenizer
from tokenizers.models import Unigram

from lumensift.llm.token_counts import MARK, Vocabulary, count_tokens, default_model, load_vocabulary, text_counter, word_counter
from pyspark.sql import types as T


def brute(word, v):
    """Every segmentation, by plain dynamic programming over starts in ascending order."""
    best = [(0.0, 0)] + [None] * len(word)
    for a in range(len(word)):
        single = False
        for b in range(a + 1, len(word) + 1):
            s = v.pieces.get(word[a:b])
            if s is not None:
                single = single or b == a + 1
                if best[b] is None or best[a][0] + s > best[b][0]:
                    best[b] = (best[a][0] + s, best[a][1] + 1)
        if not single:
            s = best[a][0] + v.lowest - 10
            if best[a + 1] is None or s > best[a + 1][0]:
                best[a + 1] = (s, best[a][1] + (len(word[a].encode()) if v.bytes_for_unknown else 1))
    return best[-1][1]


def test_equals_public_unigram_tokenizer():
    v = load_vocabulary(default_model())
    vocab = [("<unk>", 0.0)] + [(f"<0x{b:02X}>", v.lowest - 5) for b in range(256)] + list(v.pieces.items())
    public = Unigram(vocab, unk_id=0, byte_fallback=True)
    # Its lowest score includes the byte pieces; take ours alike.
    ours = word_counter(Vocabulary(v.pieces, v.lowest - 5, True))
    rng = random.Random(1)
    words = ["the", "Erhation", "naïve\nrésumé", "日本語テキスト", "🙂🙂", "x" * 300, "", "ﬁ123,456.78", "ÉOUÇ!!", "\t\ttab"]
    words += ["".join(rng.choice("abcdehtionéü.,日🙂\n ") for _ in range(rng.randint(1, 25))).replace(" ", "") for _ in range(500)]
    for w in words:
        assert ours(MARK + w)[0] == len(public.tokenize(MARK + w)), w


def test_ties_and_random_vocabularies_against_brute_force():
    rng = random.Random(2)
    for _ in range(60):
        pieces = {"".join(rng.choice("ab" + MARK) for _ in range(rng.randint(1, 4))): -float(rng.randint(1, 4)) for _ in range(8)}
        v = Vocabulary(pieces, min(pieces.values()), rng.random() < 0.5)
        f = word_counter(v)
        for _ in range(30):
            w = MARK + "".join(rng.choice("abcé") for _ in range(rng.randint(0, 12)))
            assert f(w)[0] == brute(w, v)


def test_text_and_table(spark):
    v = load_vocabulary(default_model())
    f, w = text_counter(v), word_counter(v)
    text = "the  quick brown fox " * 3000
    assert f(text)[1] == sum(w(MARK + x)[0] for x in text.split(" "))
    assert f(None) == f("") == (0, 0, 0)
    schema = T.StructType([T.StructField(c, t) for c, t in (("doc_id", T.LongType()), ("text", T.StringType()), ("n_tokens", T.StringType()), ("__id", T.StringType()))])
    df = spark.createDataFrame([(1, "a b", None, "x"), (1, "a b", None, "x"), (None, None, "z", None), (3, "", "", "")], schema)
    got = sorted(map(tuple, count_tokens(df).collect()), key=str)
    assert got == sorted([(1, 3, 2, 2, 0), (1, 3, 2, 2, 0), (None, 0, 0, 0, 0), (3, 0, 0, 0, 0)], key=str)
    assert count_tokens(df.limit(0)).count() == 0


def test_whole_texts_with_runs_of_spaces():
    v = load_vocabulary(default_model())
    vocab = [("<unk>", 0.0)] + [(f"<0x{b:02X}>", v.lowest - 5) for b in range(256)] + list(v.pieces.items())
    public = Unigram(vocab, unk_id=0, byte_fallback=True)
    ours = text_counter(Vocabulary(v.pieces, v.lowest - 5, True))
    rng = random.Random(3)
    texts = ["a    b", "a  b", "  a", "a   ", " ", " " * 40, "def f():\n        return 1\n\n    x", f"a{MARK}  {MARK}b", "the  quick brown fox " * 30]
    texts += ["".join(rng.choice(["a", "the", "é", "\n", " ", "  ", "    ", " " * 9, MARK]) for _ in range(rng.randint(1, 30))) for _ in range(300)]
    for t in texts:
        assert ours(t)[1] == len(public.tokenize(MARK + t.replace(" ", MARK))), t
    assert text_counter(v)("a    b")[:2] == (5, 3)
    # Pieces that cross a word, in a made vocabulary.
    made = Vocabulary({MARK: -3.0, "a": -3.0, "b": -3.0, f"a{MARK}b": -1.0, f"{MARK}a": -2.0}, -3.0, False)
    assert text_counter(made)("a b")[:2] == (2, 2)


def test_counts_are_close_to_the_merges_of_the_model(spark):
    """The vocabulary is that of a BPE model: its ranks, read by Zipf's law, give nearly as many tokens as its merges."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=default_model())
    texts = [r.text or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()] + ["The quick brown fox jumps over the lazy dog."]
    count, plain = text_counter(load_vocabulary(default_model())), text_counter(load_vocabulary(default_model(), zipf=None))
    merged = sum(len(model.encode(t)) for t in texts)
    assert abs(sum(count(t)[1] for t in texts) / merged - 1) < 0.02 < 0.1 < sum(plain(t)[1] for t in texts) / merged - 1
    assert count("Hello world")[1] == len(model.encode("Hello world")) == 2
