import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from chronaxis.llm.packing import Codec, pack
from tests.llm.fixtures import awkward, frame, query

PATH = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = ["", " ", "  ", "a  b", "a   b", "a \n b", "a\n b", "a \nb", "a\n\nb", " lead", "trail ", "x  y", "it's we'll\tgo", "<|endoftext|> x", "ünï 東京 1234 　 z", "a  b", "\n", "a.\nErt ion"]


@pytest.mark.parametrize("text", TEXTS)
def test_ids_equal_the_tokenizer(text):
    want = Tokenizer.from_file(PATH).encode(text, add_special_tokens=False).ids
    assert np.frombuffer(Codec(PATH).encode(text), "<u4").tolist() == want


def check(rows, texts):
    """Round trip: pieces cover each document once; sequences are gapless and within bounds."""
    tokenizer = Tokenizer.from_file(PATH)
    sequences = defaultdict(list)
    pieces = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
        pieces[r.doc_id].append(r)
    padding = 0
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at <= 2048
        padding += 0 if at & (at - 1) == 0 else 2048 - at
    assert padding == 0
    by_id = defaultdict(list)
    for doc_id, text in texts:
        by_id[doc_id].append(text or "")
    assert set(by_id) == set(pieces)
    for doc_id, own in by_id.items():
        if len(set(own)) > 1:
            continue
        ids = np.array([*tokenizer.encode(own[0], add_special_tokens=False).ids, 1], "<u4")
        covered = np.zeros(len(ids), int)
        for r in pieces[doc_id]:
            assert r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())
            covered[r.start : r.start + r.length] += 1
        assert (covered == len(own)).all()


def test_query_round_trip(spark, tmp_path):
    check(query(spark, "op9_packing", tmp_path), [r[:2] for r in awkward()])


def test_many_open_windows(spark):
    rows = [(i, "w " * (i * 37 % 900), None, None, None) for i in range(900)]
    check(pack(frame(spark, rows).coalesce(1), PATH).collect(), [r[:2] for r in rows])


def test_step_groups_are_balanced(spark):
    rows = [(i, "w " * 5000, None, None, None) for i in range(300)]
    got = pack(frame(spark, rows).coalesce(1), PATH).filter("window = 2048").groupBy("step_group").sum("length").collect()
    sums = sorted(r[1] for r in got)
    assert sums[1:] and set(sums[1:]) == {1 << 16}


def test_empty_table(spark, tmp_path):
    assert query(spark, "op9_packing", tmp_path, rows=[]) == []
