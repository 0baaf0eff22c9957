import random

import numpy as np
import public_tokenizers
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from odd_rows import ROWS, clashing, folder, table

from lacuna.llm import pieces as P

SMALL = [("<unk>", -np.inf, None), *((f"<0x{b:02X}>", 0.0, b) for b in range(256))] + [
    (p.replace(" ", P.MARKER), s, None)
    for p, s in ((" ", -3.0), ("  ", -4.0), (" a", -2.0), ("a", -2.5), ("b", -2.6), ("ab", -3.1), (" ab", -3.4), ("aba", -4.0), ("c", -5.0), ("bc", -5.2), ("é", -4.0), ("aéb", -6.0), ("abcab", -7.0))
]
V = P.Vocabulary.of(SMALL)
CODER = P.Coder(V)
PUBLIC = P.public_vocabulary()
PUBLIC_CODER = P.Coder(PUBLIC)


def best_score(text):
    """The largest sum of scores over all cuts of the whole text, by plain dynamic programming."""
    t = " " + text
    pieces = {p.replace(P.MARKER, " "): s for p, s, b in SMALL if b is None and s > -np.inf}
    byte = V.score[V.byte_piece[0]]
    best = [0.0] + [-np.inf] * len(t)
    for i in range(len(t)):
        for j in range(i + 1, len(t) + 1):
            if t[i:j] in pieces:
                best[j] = max(best[j], best[i] + pieces[t[i:j]])
        if t[i] not in pieces:
            best[i + 1] = max(best[i + 1], best[i] + byte * len(t[i].encode()))
    return best[-1]


@settings(max_examples=600, deadline=None)
@given(st.text(alphabet="ab cé字😀\n▁", max_size=25))
def test_cut_is_the_best_and_decodes(text):
    ids = CODER.encode([text])[0]
    assert CODER.decode(ids) == text
    if text:
        assert abs(V.score[ids].sum() - best_score(text)) < 1e-9


@settings(max_examples=400, deadline=None)
@given(st.text(max_size=60))
def test_public_vocabulary_round_trip(text):
    assert PUBLIC_CODER.decode(PUBLIC_CODER.encode([text])[0]) == text


def test_trie_holds_every_piece_and_no_other():
    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    t, code = PUBLIC.trie, PUBLIC.code

    def find(word):
        node = 0
        for c in word.replace(P.MARKER, " "):
            to = t.base[node] + code[ord(c)]
            if not code[ord(c)] or t.check[to] != node:
                return -1
            node = to
        return int(t.value[node])

    usable = [i for i in range(model.get_piece_size()) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i)) and model.get_score(i) > P.UNUSED]
    assert all(find(model.id_to_piece(i)) == i for i in usable)
    pieces, rng = {model.id_to_piece(i) for i in usable}, random.Random(1)
    for i in rng.sample(usable, 3000):
        other = model.id_to_piece(i)[:-1] + rng.choice("qxz字")
        assert (find(other) >= 0) == (other in pieces)


def test_pieces_are_those_of_the_library_where_the_cut_is_the_same():
    """Single known pieces get the id that the library knows them by."""
    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    for word in ("the", "and", "with", "house"):
        assert [model.id_to_piece(int(i)) for i in PUBLIC_CODER.encode([word])[0]] == [P.MARKER + word]


def test_a_long_word_and_forgetting(monkeypatch):
    monkeypatch.setattr(P, "MEMO", 3)
    coder = P.Coder(V)
    for text in ("ab" * 20_000, "ab c", "a b c ab abc", "", " ", "  "):
        assert coder.decode(coder.encode([text, text])[1]) == text


def test_odd_rows(spark, tmp_path):
    rows = P.op10_sentencepiece(spark, folder(clashing(table(spark)), tmp_path)).collect()
    text = {}
    for i, t, *_ in ROWS:
        text.setdefault(i, []).append(t or "")
    assert len(rows) == len(ROWS) and all(r.round_trip and r.n_pieces == len(r.piece_ids) for r in rows)
    for r in rows:
        assert PUBLIC_CODER.decode(np.array(r.piece_ids, np.int64)) in text[r.doc_id]


def test_empty_table(spark, tmp_path):
    assert P.op10_sentencepiece(spark, folder(table(spark, []), tmp_path)).collect() == []


def test_query_decodes_to_the_table(spark):
    rows = P.op10_sentencepiece(spark, "/root/testdata/sf0.01")
    back = P.decoded(rows, PUBLIC).select("doc_id", "text")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    assert back.exceptAll(docs).count() == 0 and back.count() == docs.count()
