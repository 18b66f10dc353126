"""Decoding like the library, texts without blanks, and vocabularies whose pieces cross words."""

import random
import struct
import time

import numpy as np
import pytest

from curbflow.llm import pieces

MARK = "▁"
JAPANESE = "これは日本語のテストです。機械学習のための大規模なテキストを処理する。東京、本文抽出と品質評価を行いました。"


def brute(own, text):
    """Best score of the whole line, over all its segmentations into pieces and unknown characters."""
    line = (" " + text).replace(MARK, "\0").replace(" ", MARK)
    table = {own.texts[i].decode(): own.scores[i] for i, k in enumerate(own.kinds) if k in (pieces.NORMAL, pieces.USER)}
    best = [0.0] + [-np.inf] * len(line)
    for i in range(len(line)):
        for j in range(i + 1, min(len(line), i + 24) + 1):
            if line[i:j] in table:
                best[j] = max(best[j], best[i] + table[line[i:j]])
            elif j == i + 1:
                best[j] = max(best[j], best[i] + own.unknown_score)
    return best[-1]


def score(own, ids, text):
    """Of these ids; the bytes of a character count as one unknown piece."""
    low, high = min(own.bytes.values()), max(own.bytes.values())
    total, spelled = 0.0, b""
    for i in ids:
        if low <= i <= high:
            spelled += bytes([i - low])
        else:
            total += own.scores[i]
    return total + own.unknown_score * len(spelled.decode())


def test_decode_like_the_library():
    sentencepiece = pytest.importorskip("sentencepiece")
    own, theirs = pieces.model(pieces.vocabulary()), sentencepiece.SentencePieceProcessor(model_file=pieces.vocabulary())
    draw = random.Random(1)
    usable = [i for i, k in enumerate(own.kinds) if k in (pieces.NORMAL, pieces.BYTE, pieces.CONTROL) and own.texts[i].strip(MARK.encode())]
    lists = [[theirs.piece_to_id(x)] for x in ("om", "▁om", "<0x41>", "<0x20>")] + [[draw.choice(usable) for _ in range(draw.randint(1, 8))] for _ in range(2000)]
    for ids in lists:
        assert own.decode(ids).decode("utf-8", "replace").replace("�", "") == theirs.decode(ids).replace("�", "")
    assert own.decode(lists[0]) == b"om" and own.decode([]) == b""


def test_texts_without_blanks():
    own, draw = pieces.model(pieces.vocabulary()), random.Random(2)
    texts = ["".join(draw.choice(chars) for _ in range(draw.randint(60, 400))) for chars in (JAPANESE, "abcdefghij", "aé日😀\x01", "the", "a", "0123456789abcdef▁") for _ in range(8)]
    for text, ids in zip(texts, own.encode([t.encode() for t in texts]), strict=True):
        assert own.decode(ids).decode() == text
        assert score(own, ids, text) == pytest.approx(brute(own, text))


def test_long_and_short_segments_agree(monkeypatch):
    own, draw = pieces.Unigram(pieces.vocabulary()), random.Random(3)
    texts = ["".join(draw.choice("etaoin shrdlu日本") for _ in range(60)).encode() for _ in range(200)]
    whole = own.encode(texts)
    monkeypatch.setattr(pieces, "LONG", 3)
    monkeypatch.setattr(pieces, "POSITIONS", 5)
    own.known.clear()
    assert own.encode(texts) == whole


def test_speed_without_blanks():
    own, draw = pieces.model(pieces.vocabulary()), random.Random(4)
    text = "".join(draw.choice(JAPANESE) for _ in range(200_000)).encode()
    began = time.process_time()
    ids = own.encode([text])[0]
    assert time.process_time() - began < 2 * len(text) / 1e6 and own.decode(ids) == text


def write_model(path, entries):
    """A unigram vocabulary file of (piece, score, kind)."""
    field = lambda number, data: bytes([number << 3 | 2, len(data)]) + data
    out = b"".join(field(1, field(1, t.encode()) + b"\x15" + struct.pack("<f", s) + bytes([0x18, k])) for t, s, k in entries)
    path.write_bytes(out + field(2, b"\x18\x01"))
    return str(path)


def test_pieces_across_words(tmp_path):
    normal = [("a", -3), ("b", -3), (MARK, -4), (f"{MARK}a", -2), (f"a{MARK}b", -2.5), (f"b{MARK}{MARK}a", -3.5), ("ab", -4.5), (f"{MARK}b{MARK}a", -5)]
    entries = [("<unk>", 0, pieces.UNKNOWN), *[(f"<0x{i:02X}>", 0, pieces.BYTE) for i in range(256)], *[(t, s, pieces.NORMAL) for t, s in normal]]
    own, draw = pieces.Unigram(write_model(tmp_path / "m.model", entries)), random.Random(5)
    assert not own.separable
    for _ in range(200):
        text = "".join(draw.choice("aab  cé") for _ in range(draw.randint(1, 120)))
        ids = own.encode([text.encode()])[0]
        assert own.decode(ids).decode() == text and score(own, ids, text) == pytest.approx(brute(own, text))
