"""Language identification: held-out accuracy, rejection and edge cases."""

import os
import zlib

import pytest

from helpers import docs
from timesift.llm import language
from timesift.llm.common import table

SF = "/root/testdata/sf0.01"


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")
def test_held_out_accuracy(spark):
    lang = {r.doc_id: r.lang for r in table(spark, SF, "documents").collect()}
    got = language.identify(table(spark, SF, "documents")).collect()
    held = [r for r in got if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in got)
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.97 * len(held)
    sure = [r for r in held if r.accepted]
    assert len(sure) > 0.5 * len(held) and sum(r.lang_pred == lang[r.doc_id] for r in sure) >= 0.98 * len(sure)


def test_edges(spark):
    rows = [(i, f"the quick brown fox and then number {i}", "s", "en") for i in range(60)]
    rows += [(100 + i, f"der schnelle braune fuchs und dann nummer {i}", "s", "de") for i in range(60)]
    rows += [(300, None, "s", "en"), (301, "", "s", None), (302, "123 !!", "s", "de"), (303, "и", "s", None), (None, "the fox", "s", "en"),
             (5, rows[5][1], "s", "en"), (304, "the " * 200_000, "s", None)]
    table_ = docs(spark, rows, extra=True)
    got = {r.doc_id: r for r in language.identify(table_).collect()}
    assert [got[i].lang_pred for i in (300, 301, 302)] == ["und"] * 3 and got[300].score == 0
    assert got[303].lang_pred in ("en", "de") and got[304].lang_pred == "en"
    assert sum(got[i].lang_pred == ("en" if i < 100 else "de") for i in range(160) if i in got) >= 118
    assert language.identify(table_).count() == len(rows)
    nothing = language.identify(docs(spark, [(1, "abc", "s", None)])).collect()
    assert [(r.lang_pred, r.score) for r in nothing] == [("und", 0.0)]
    assert language.identify(table_.limit(0)).count() == 0


def test_numbers_that_are_no_letters_are_und(spark):
    rows = [(i, "the words of this text here", "a", "en") for i in range(8)] + [(i, "½ ² Ⅷ ① 12", "a", "en") for i in (100, 101)] + [(102, "Ω", "a", "en")]
    got = {r.doc_id: r.lang_pred for r in language.identify(docs(spark, rows)).collect()}
    assert got[100] == got[101] == "und" and got[102] == "en"
