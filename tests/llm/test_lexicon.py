import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerloom.llm import lexicon as L
from ledgerloom.llm import tokens as T

ENCODING = T.byte_encoding(T.TOKENIZERS)
ODD = ["", " ", "<|endoftext|> a  b\n\n\t c d \x1c\x1d! ¼½ ²a's'S 'll　x", "\n" * 500, "ab" * 9000, "a\r\r\n\f b  c", "日本語 текст 🙂🙂", "x́  y", None]


def test_automaton(tmp_path):
    words = {w.encode(): [i, i + 1][: 1 + i % 2] for i, w in enumerate(["a", "walking", "talking", "walk", "ß", " the", "the", "", "talk"])}
    path = tmp_path / "l.bin"
    path.write_bytes(L.compile_lexicon(words))
    lex = L.Lexicon(str(path))
    for w, ids in words.items():
        assert list(memoryview(lex[w]).cast("i")) == ids
    for w in (b"wal", b"walkingx", b"x", b"t", b"alking"):
        assert lex[w] is None
    assert lex.states < 20  # suffixes are shared


def test_empty_automaton(tmp_path):
    (tmp_path / "l").write_bytes(L.compile_lexicon({}))
    assert L.Lexicon(str(tmp_path / "l"))[b"a"] is None


def test_equals_the_tokenizer(spark):
    df = spark.createDataFrame([(i, t, [1]) for i, t in enumerate(ODD + ODD)], "doc_id long, text string, ids array<int>")
    got = {r.doc_id: r.ids for r in L.encode_corpus(df).collect()}
    assert got == {i: ENCODING.encode_ordinary(t or "") for i, t in enumerate(ODD + ODD)}
    assert L.encode_corpus(df.limit(0)).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("ab1 \n\t\r\f.'s é  \x1c日"), max_size=30))
def test_pieces_are_independent(text):
    """Sizes by pieces equal those of whole texts, for every tokenizer."""
    import sentencepiece
    from tokenizers import Tokenizer

    global _sp, _w
    if "_sp" not in globals():
        _sp = sentencepiece.SentencePieceProcessor(model_file=f"{T.TOKENIZERS}/piece_bpe_32k.model")
        _w = Tokenizer.from_file(f"{T.TOKENIZERS}/word_bpe_49k.json")
        _w.encode_special_tokens = True
    got = T.counts(T.TOKENIZERS, ["byte_bpe_50k", "piece_bpe_32k", "word_bpe_49k"], [text])
    assert [g[0] for g in got] == [len(ENCODING.encode_ordinary(text)), len(_sp.encode(text)), len(_w.encode(text, add_special_tokens=False).ids)]


def test_runs_and_first_pieces_are_sized_once(monkeypatch):
    """A run's words are cut once for all budgets of a tokenizer, and the piece a text begins with is encoded once."""
    cut, cuts, encoded = T.byte_words(), [], []
    monkeypatch.setattr(T, "byte_words", lambda: lambda p: cuts.append(p) or cut(p))
    byte, run = T._byte_sizer(T.TOKENIZERS, "byte_bpe_50k"), "支払期限は翌月末日です。" * 40
    assert byte([run]) == [len(ENCODING.encode_ordinary(run))]
    assert byte.words(run) == byte.words(run) and sum(n for n, _ in byte.words(run)) == len(run)
    assert cuts == [run]
    sizer = T.Sizer(lambda p: encoded.append(p) or 1, lambda p: 2)
    assert sizer(["ab"]) == [2] and sizer(["ab", " c"]) == [2, 1] and sizer([]) == []
    assert encoded == [" c"]


@pytest.mark.parametrize("name", ["byte_bpe_50k", "word_bpe_49k"])
def test_odd_words(name):
    """Words that are merged without the tokenizer's own cut have the sizes it gives them."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(f"{T.TOKENIZERS}/word_bpe_49k.json")
    t.encode_special_tokens = True
    encode = ENCODING.encode_ordinary if name == "byte_bpe_50k" else lambda p: t.encode(p, add_special_tokens=False).ids
    for p in ("<|startoftext|>", " <|ENDoftext|>'s", "a\x00\x07b\x7f", "'''S'LL", " €8,125.03", "  \t$-.07", "z" * 100, "Z9" * 51, "İstanbul", "ΣΑΣ", "x\x1cy"):
        assert T.counts(T.TOKENIZERS, [name], [p]) == [[len(encode(p))]], p


def test_unknown_tokenizer():
    with pytest.raises(FileNotFoundError):
        T.sizer(T.TOKENIZERS, "none")
