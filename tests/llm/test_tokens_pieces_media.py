import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tabsplit.llm import media, pieces, tokens

BPE, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    import sentencepiece
    from tokenizers import Tokenizer

    return Tokenizer.from_file(BPE), sentencepiece.SentencePieceProcessor(model_file=PIECES)


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=300))
def test_both_agree_with_their_libraries_on_any_text(text):
    from tokenizers import Tokenizer

    vocab, model = tokens.vocabulary(BPE, public_tokenizers.PATTERN), pieces.model(PIECES)
    if not hasattr(test_both_agree_with_their_libraries_on_any_text, "own"):
        import sentencepiece

        test_both_agree_with_their_libraries_on_any_text.own = Tokenizer.from_file(BPE), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    bpe, sp = test_both_agree_with_their_libraries_on_any_text.own
    assert vocab.count([text]) == [len(bpe.encode(text, add_special_tokens=False).ids)]
    ids = np.frombuffer(model.encode([text])[0], dtype="<i4").tolist()
    assert ids == sp.encode(text)
    assert model.decode(ids) == sp.decode(ids)


def test_runs_spaces_and_long_words(library):
    bpe, sp = library
    random.seed(3)
    texts = ["", " ", "a" * 3000, " " * 200, "aaa aaaa  aaaaa", "<|endoftext|>x<|endoftext|>", "".join(random.choice("ab \n") for _ in range(5000))]
    assert tokens.vocabulary(BPE, public_tokenizers.PATTERN).count(texts) == [len(x.ids) for x in bpe.encode_batch(texts, add_special_tokens=False)]
    found = [np.frombuffer(x, dtype="<i4").tolist() for x in pieces.model(PIECES).encode(texts)]
    assert found == sp.encode(texts)


def test_counts_of_odd_rows(documents, odd_rows, library):
    found = tokens.count_tokens(documents(odd_rows), BPE, public_tokenizers.PATTERN).collect()
    expected = sorted((r[0] or -1, len((r[1] or "").encode()), len(library[0].encode(r[1] or "", add_special_tokens=False).ids)) for r in odd_rows)
    assert sorted((r.doc_id or -1, r.n_bytes, r.n_tokens) for r in found) == expected


def test_round_trip_of_odd_rows(documents, odd_rows, library):
    coded = pieces.decode(pieces.encode(documents(odd_rows), PIECES), PIECES).select("text", "ids", "decoded").collect()
    assert sorted(map(str, pieces.round_trip(documents(odd_rows), PIECES).select("text", "ids", "decoded").collect())) == sorted(map(str, coded))
    for r in coded:
        assert list(r.ids) == library[1].encode(r.text or "")
        assert r.decoded == (r.text or "").replace("▁", " ")


def test_media_round_trip(spark, documents, odd_rows, tmp_path):
    media.write_archive(documents(odd_rows), f"file://{tmp_path}/a")
    found = media.media_features(media.read_archive(spark, f"file://{tmp_path}/a")).collect()
    expected = []
    for doc_id, text, *_ in odd_rows:
        data = (text or "").encode()
        padded = data + bytes(-len(data) % 64 or (0 if data else 64))
        expected.append((doc_id or -1, len(data), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:])))
    assert sorted((r.doc_id or -1, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in found) == sorted(expected)
    assert all(r.error is None for r in found)


def test_a_damaged_member_is_one_row_with_an_error(spark, documents, tmp_path):
    docs = documents([(k, f"document {k} " * 20) for k in range(30)]).coalesce(1)
    media.write_archive(docs, f"file://{tmp_path}/b")
    path = next((tmp_path / "b").glob("*.zip"))
    data, at = bytearray(path.read_bytes()), media.members(str(path))[7].header_offset + 60
    data[at] ^= 255
    path.write_bytes(data)
    found = media.media_features(media.read_archive(spark, f"file://{tmp_path}/b")).collect()
    assert len(found) == 30 and sum(r.error is not None for r in found) == 1


def test_ranges_share_out_members(spark, documents, tmp_path, monkeypatch):
    monkeypatch.setattr(media, "RANGE_BYTES", 700)
    media.write_archive(documents([(k, f"number {k}") for k in range(50)]), f"file://{tmp_path}/c")
    reader = media.ArchiveReader(f"file://{tmp_path}/c")
    rows = [x for p in reader.partitions() for b in reader.read(p) for x in b.column("doc_id").to_pylist()]
    assert sorted(rows) == list(range(50)) and len(reader.partitions()) > 5


def test_a_failing_read_is_tried_again(tmp_path, spark, documents):
    media.write_archive(documents([(1, "once")]), f"file://{tmp_path}/d")
    path = str(next((tmp_path / "d").glob("*.zip")))

    class Broken:
        def seek(self, at):
            raise OSError("gone")

        def close(self):
            pass

    assert media.read_member(path, media.members(path)[0], [Broken()])[:8] == media.SIGNATURE


def test_empty_table(spark, documents, tmp_path):
    empty = documents([(1, "x")]).where("false")
    assert tokens.count_tokens(empty, BPE, public_tokenizers.PATTERN).count() == 0
    assert pieces.encode(empty.select("doc_id", "text"), PIECES).count() == 0
    media.write_archive(empty, f"file://{tmp_path}/e")
    assert media.read_archive(spark, f"file://{tmp_path}/e").count() == 0
