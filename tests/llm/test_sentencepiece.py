import struct
import zlib

import numpy as np
import pytest
from sentencepiece import SentencePieceProcessor

from tests.llm import cases
from tidemark.llm import sentencepiece_codec as sc

MORE = ["  two  spaces ", "tail ", "a▁b", "line\n\nfeeds\n x", "\n", " ", "日本語 テキスト", "mixed\ttabs\r\n", "<s> </s> <unk> <0x41>"]


def varint(n):
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def message(number, data):
    return varint(number << 3 | 2) + varint(len(data)) + data


def handmade(squeeze):
    """A unigram model of a few pieces with byte fallback."""
    pieces = [("<unk>", 0, 2), ("<s>", 0, 3), ("</s>", 0, 3)] + [(f"<0x{b:02X}>", 0, 6) for b in range(256)]
    pieces += [(p, s, 1) for p, s in [("▁", -2.0), ("a", -3.0), ("b", -3.1), ("ab", -4.0), ("▁a", -3.5), ("▁ab", -4.2), ("ba", -4.4), ("▁b", -4.7)]]
    body = b"".join(message(1, message(1, p.encode()) + b"\x15" + struct.pack("<f", s) + b"\x18" + bytes([t])) for p, s, t in pieces)
    body += message(2, b"\x18\x01" + varint(35 << 3) + b"\x01")
    return body + message(3, message(1, b"identity") + b"\x18\x01" + b"\x20" + bytes([squeeze]) + b"\x28\x01")


@pytest.mark.parametrize("squeeze", [0, 1])
def test_unigram_parity(squeeze, tmp_path):
    data = handmade(squeeze)
    (tmp_path / "m.model").write_bytes(data)
    library, codec = SentencePieceProcessor(model_proto=data), sc.Codec(str(tmp_path / "m.model"))
    texts = ["ab ba", "  a  b ", "abab baba", "xyz ab", "é a", "", "aab b"]
    for text, (ids, _, parity, _) in zip(texts, codec.encode([t.encode() for t in texts])):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode(text) and parity, text
    whole = codec.model.tokenizer()
    for text in texts[:5]:
        assert whole.encode(text, add_special_tokens=False).ids == library.encode(text)


def test_parity_and_round_trip(spark):
    texts = cases.TEXTS + MORE
    docs = cases.documents(spark, texts)
    library = sc.Codec(sc.default_model()).model.processor(True)
    rows = sc.encode(docs)
    assert rows.count() == docs.count()
    for r in rows.where("doc_id is not null").collect():
        want = library.encode(texts[r["doc_id"]] or "")
        assert r["ids"] == want and r["n_tokens"] == len(want) and r["parity"] and r["roundtrip"]
        assert r["ids_crc32"] == zlib.crc32(np.array(want, "<u4").tobytes())
    back = {r["doc_id"]: r["text"] for r in sc.decode(rows).collect()}
    for i, t in enumerate(texts):
        assert back[i] == (t or "").replace("▁", " ")


def test_whole_text_tokenizer_agrees():
    codec = sc.Codec(sc.default_model())
    whole, library = codec.model.tokenizer(), codec.model.processor(True)
    for t in [cases.PROSE, "Hello  world\nfoo é", "日本語 x"]:
        assert whole.encode(t, add_special_tokens=False).ids == library.encode(t)


def test_empty_table(spark):
    assert sc.encode(cases.no_documents(spark)).count() == 0


def test_ids_come_from_the_rebuilt_tokenizer(tmp_path):
    path = tmp_path / "made.model"
    path.write_bytes(handmade(False))
    codec = sc.Codec(str(path))
    want = codec.tokenizer.encode(codec.chunks("abba")[0], add_special_tokens=False).ids

    class Other:
        def encode(self, texts, **_):
            return [[5] for _ in texts]

    codec.processor = Other()
    (ids, fallback, parity, decoded), = codec.encode([b"abba"])
    assert np.frombuffer(ids, "<u4").tolist() == want != [5] and (fallback, parity, decoded) == (0, False, b"abba")
