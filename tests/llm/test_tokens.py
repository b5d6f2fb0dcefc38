import json
import random
import zlib
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from assay.llm import idfiles, pieces
from assay.llm.common import folder
from tests.llm import data

VOCABULARY = public_tokenizers.path(idfiles.VOCABULARY)
MODEL = public_tokenizers.path(pieces.MODEL)
ODD = ["", "Á ́x <|endoftext|> B it's IT'S 12ab\x1c\x1dz  q ΑΣ ΑΣ", "<|startoftext|> a", "<|ENDOFTEXT|> X", "\tΣ \n",
       "ab, c.. d.\n e!. ʼn n't. ª º ٣a 中文, ﬁ İ ǆ áb a,\nB.\tc a,b .c"]


def test_words_give_the_ids_of_whole_texts():
    from tokenizers import Tokenizer

    texts = [t or "" for t in data.texts() if len(t or "") < 5_000] + ODD
    whole = Tokenizer.from_file(VOCABULARY)
    ids, sizes = idfiles.vocabulary_ids(VOCABULARY)([t.encode() for t in texts])
    for t, got in zip(texts, idfiles.slices(ids, sizes)):
        assert got.tolist() == whole.encode(t, add_special_tokens=False).ids, t


def test_words_are_kept_and_dropped():
    from tokenizers import Tokenizer

    whole, made = Tokenizer.from_file(VOCABULARY), idfiles.VocabularyIds(VOCABULARY)
    made.words.limit = 30
    texts = ["word", "word.", "word, word.", "word"] + [data.text(s, 40).replace(" ", ", ", 5) for s in range(30)] + ["word. word"]
    for t in texts:  # one by one, so that words known from before meet fresh ones, or none
        ids, sizes = made([t.encode()])
        assert ids.tolist() == whole.encode(t, add_special_tokens=False).ids and sizes.tolist() == [len(ids)]


@pytest.mark.parametrize("bit_planes", [True, False])
@pytest.mark.parametrize("bits", [1, 7, 16, 17, 32])
def test_planes_round_trip(bit_planes, bits):
    rng = np.random.default_rng(bits)
    for n in (0, 1, 7, 8, 9, 100, 1000):
        ids = rng.integers(0, 2 ** bits, n).astype(np.uint32)
        planes, ends = idfiles.to_planes(ids, bit_planes, bits, 64)
        assert (idfiles.from_planes(planes, ends, n, bit_planes, bits, 64) == ids).all()


@pytest.mark.parametrize("bit_planes", [True, False])
def test_files_round_trip(spark, bit_planes):
    from tokenizers import Tokenizer

    whole, rows = Tokenizer.from_file(VOCABULARY), data.rows()
    path = folder(spark, "test-planes")
    idfiles.write_ids(data.frame(spark), path, VOCABULARY, bit_planes=bit_planes, block=50, chunk=400, parts=5)
    got = idfiles.read_ids(spark, path, with_ids=True).collect()
    assert len(got) == len(rows)
    want = sorted((str(r[0]), [*whole.encode(r[1] or "", add_special_tokens=False).ids, 1]) for r in rows)
    assert sorted((str(g.doc_id), list(g.ids)) for g in got) == want
    start = 0
    for g in sorted(got, key=lambda g: g.start):
        assert g.start == start and g.n_tokens == len(g.ids)
        assert g.ids_crc32 == zlib.crc32(np.array(g.ids, dtype="<u4").tobytes())
        start += g.n_tokens
    order = [g.doc_id for g in sorted(got, key=lambda g: g.start) if g.doc_id is not None]
    assert order == sorted(order)
    index = idfiles.chunk_index(spark, path).collect()
    assert sum(c.n_ids for c in index) == start and all(sum(c.doc_sizes) == c.n_ids for c in index)


def test_files_of_an_empty_table(spark):
    path = folder(spark, "test-planes")
    idfiles.write_ids(data.empty(spark), path, VOCABULARY)
    assert idfiles.read_ids(spark, path).collect() == []


def odd_pieces():
    rng = random.Random(2)
    return ["".join(rng.choice(" ▁ ab\nézthe  \t梦<|") for _ in range(rng.randint(0, 30))) for _ in range(1500)] + [
        "a" * 15, " " * 6, "▁▁x", " a", "a ", "", "a b\nc d", "\x00", "<0x41>", "<s> </s> <unk>"]


def test_pieces_have_parity_with_the_original():
    made, theirs = pieces.Encoder(open(MODEL, "rb").read()), sentencepiece.SentencePieceProcessor(model_file=MODEL)
    texts = [t or "" for t in data.texts()] + odd_pieces()
    for t, got, want in zip(texts, made.encode([t.encode() for t in texts]), theirs.encode(texts)):
        assert got.tolist() == want, t


def test_pieces_decode():
    made = pieces.Encoder(open(MODEL, "rb").read())
    texts = [t or "" for t in data.texts()] + odd_pieces()
    ids, sound, same = made.checked([t.encode() for t in texts])
    for t, back, ok in zip(texts, made.decode(ids), sound):
        assert back == t.replace("▁", " ") and ok == (back == t)
    assert not any(s for s, t in zip(same, texts) if t)  # nothing to compare with


def test_parity_is_told_by_stretches_and_holds_for_whole_texts():
    theirs = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    made = pieces.Encoder(open(MODEL, "rb").read(), theirs=theirs)
    texts = [t or "" for t in data.texts()] + odd_pieces()
    ids, _, same = made.checked([t.encode() for t in texts])
    assert all(same) and all(a.tolist() == b for a, b in zip(ids, theirs.encode(texts)))
    made.forget()
    made.theirs = type("Other", (), {"encode": lambda self, texts, num_threads: [[7]] * len(texts)})()
    assert made.checked([b"one two"])[2] == [False]


def test_unigram_models_are_rebuilt_too():
    model = pieces.Model(["<unk>", "▁", "a", "b", "ab", "▁ab", *[f"<0x{i:02X}>" for i in range(256)]], [0.0, -3.0, -2.0, -2.0, -2.5, -2.2] + [0.0] * 256,
                         [2, 1, 1, 1, 1, 1] + [6] * 256, pieces.UNIGRAM, True)
    made = pieces.backend(model)
    assert made.encode("▁abab").ids == [5, 4] and made.encode("▁é").ids == [1, 6 + 0xC3, 6 + 0xA9]


def test_piece_rows(spark):
    got = pieces.encode_documents(data.frame(spark), ["doc_id", "kept"], MODEL).collect()
    assert len(got) == len(data.rows()) and all(g.parity and g.n_tokens == len(g.ids) for g in got)
    assert pieces.encode_documents(data.empty(spark), ["doc_id"], MODEL).collect() == []


@pytest.mark.parametrize("change", [{"normalizer": None}, {"normalizer": {"type": "Lowercase"}, "pre_tokenizer": None}, {}])
def test_other_vocabularies_are_encoded_as_the_library_does(tmp_path, change):
    from tokenizers import Tokenizer

    made = json.loads(Path(VOCABULARY).read_text()) | change
    path = tmp_path / "vocabulary.json"
    path.write_text(json.dumps(made))
    whole, ours = Tokenizer.from_file(str(path)), idfiles.VocabularyIds(str(path))
    assert ours.apart == (not change)
    texts = [(t or "") for t in data.texts()[:12]] + ["Straight On, Sir. HELLO World 12.5 É", "  two  spaces\n\nlines "]
    ids, sizes = ours([t.encode() for t in texts])
    assert [x.tolist() for x in idfiles.slices(ids, sizes)] == [whole.encode(t, add_special_tokens=False).ids for t in texts]
