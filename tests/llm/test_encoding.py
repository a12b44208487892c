"""SentencePiece encoding against the library, and its normalizer with a character map."""

import hashlib
import random
import struct

import numpy as np
import public_tokenizers
import sentencepiece

from tests.llm.conftest import collected
from wattline.llm.encoding import encode_texts, encoded_digests
from wattline.llm.pieces import PieceModel, _fields

MODEL = public_tokenizers.path("piece_bpe_32k.model")
TEXTS = ["", " ", "  ", "\n", " \n a", "a\0b", "▁", "a▁b", " ▁ x", "<s> hi </s> <0x41> <unk>", "éé一😀\n😀 \r\n\t x  y   z  ",
         "a" * 3000, "\n\n\n", "x \n y", "﻿�", "..." * 50]


def texts():
    r = random.Random(3)
    return TEXTS + ["".join(r.choice(" \n ▁abcdeéß漢😀\t\0<>s/.") for _ in range(r.randint(0, 40))) for _ in range(500)]


def test_ids_spans_and_decoding_equal_the_library():
    library, own = sentencepiece.SentencePieceProcessor(model_file=MODEL), PieceModel(MODEL, cache_parts=100)
    for text in texts():
        ids, spans, decoded = own.encode(text)
        wanted = library.encode(text, add_bos=True, add_eos=True)
        assert ids.tolist() == wanted and decoded == library.decode(wanted) == own.decode(wanted)
        raw = text.encode()
        pieces = library.encode(text, return_type="proto").pieces
        assert [raw[a:b].decode() for a, b in spans[1:-1]] == [p.surface for p in pieces]


def test_decoding_any_ids():
    library, own, r = sentencepiece.SentencePieceProcessor(model_file=MODEL), PieceModel(MODEL), random.Random(5)
    for _ in range(500):
        ids = [r.choice([1, 2, r.randrange(3, 259), r.randrange(259, 32000)]) for _ in range(r.randrange(12))]
        assert own.decode(ids) == library.decode(ids)


def test_longest_prefix_through_a_compiled_map():
    for rule in ("nmt_nfkc", "nfkc_cf"):
        normalizer = sentencepiece.SentencePieceNormalizer(rule_name=rule)
        proto = normalizer.serialized_model_proto()
        own = PieceModel.__new__(PieceModel)
        spec = next(dict(_fields(v)) for n, v in _fields(proto) if n == 3)
        from wattline.llm.pieces import CharacterMap

        own.charsmap = CharacterMap(spec[2])
        own.prefix, own.trim, own.escape = (bool(spec.get(i, 1)) for i in (3, 4, 5))
        for text in ["", " ", "ＡＢＣ １２", "ﬁ ½ ①", "é ä", "  a  b  ", "한글 한글", "Straße ΑΣ", "　x　", "㌔ km²", *texts()[16:120]]:
            shown, origin = own.normalise(text)
            assert shown == normalizer.normalize(text), (rule, text)
            assert len(origin) == len(shown.encode()) + 1 and (np.diff(origin.astype(int)) >= 0).all()
            assert origin[-1] <= len(text.encode())


def test_table(docs):
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(100, None), (None, "x"), (101, "wörter " * 30_000), (101, "wörter " * 30_000)]
    frame = docs(rows)
    got = encoded_digests(frame, MODEL).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    for i, text in rows:
        ids = library.encode(text or "", add_bos=True, add_eos=True)
        assert by[i].n_tokens == len(ids)
        assert by[i].ids_sha256 == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert by[i].decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()
    assert encode_texts(frame.where("false"), MODEL).count() == 0
    assert collected(encode_texts(frame.where("doc_id = 100"), MODEL))[100].decoded == ""
