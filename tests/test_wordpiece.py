"""Greedy word pieces (F8, J4): prefixed and bare pieces, whole-word [UNK]."""

from bitdex.operators import wordpiece as wp


def test_segment_words_literal_vocab(spark):
    vocab = spark.createDataFrame(
        [("▁un", 1), ("▁unbe", 2), ("liev", 3), ("able", 4), ("▁the", 5), ("a", 6),
         ("ble", 7), ("▁b", 8)], "token string, token_id long")
    words = spark.createDataFrame([("unbelievable",), ("the",), ("them",), ("bable",),
                                   ("zzz",)], "word string")
    got = {r.word: (r.known, list(r.piece_ids)) for r in wp.segment_words(words, vocab).collect()}
    assert got["unbelievable"] == (True, [2, 3, 4])     # longest match from the front
    assert got["the"] == (True, [5])
    assert got["them"] == (False, [0])                  # "m" unmatched -> whole word [UNK]
    assert got["bable"] == (True, [8, 4])               # "▁b" + longest "able"
    assert got["zzz"] == (False, [0])                   # no piece at all (left join keeps it)


def test_piece_profile_has_every_document(spark):
    vocab = spark.createDataFrame([("▁a", 1), ("▁b", 2)], "token string, token_id long")
    toks = spark.createDataFrame([(1, 0, "a"), (1, 1, "b"), (1, 2, "c"), (2, 0, "a"), (1, 3, "c")],
                                 "id long, pos int, token string")
    docs = spark.createDataFrame([(1,), (2,), (3,)], "id long")
    got = {r.id: (r.n_ids, r.n_unk, r.unk_share, r.over_context)
           for r in wp.piece_profile(toks, docs, vocab, n_ctx=4).collect()}
    assert got == {1: (6, 2, 0.5, True), 2: (3, 0, 0.0, False), 3: (2, 0, None, False)}


def test_token_ids_with_a_hot_word(spark):
    vocab = spark.createDataFrame([("▁a", 1), ("▁b", 2)], "token string, token_id long")
    toks = spark.createDataFrame([(i, j, "a" if j % 3 else "c") for i in range(40) for j in range(30)],
                                 "id long, pos int, token string")
    got = wp.token_ids(toks, vocab).collect()
    assert len(got) == 1200 and all(r.known == (r.token == "a") and r.piece_ids == [1 if r.known else 0] for r in got)


def _python_walk(vocab, word):
    w, ids = wp.WORD_PREFIX + word, []
    while w:
        n = max((n for n in range(1, len(w) + 1) if w[:n] in vocab), default=0)
        if not n:
            return None
        ids.append(vocab[w[:n]])
        w = w[n:]
    return ids


def test_trie_against_a_plain_walk_and_the_join(spark):
    import random
    rnd = random.Random(2)
    letters = "abcé\U0001F600"
    vocab = {rnd.choice(["", wp.WORD_PREFIX]) + "".join(rnd.choices(letters, k=rnd.randrange(1, 5))): i + 1
             for i in range(120)}
    words = sorted({"".join(rnd.choices(letters, k=rnd.randrange(1, 14))) for _ in range(400)} | {"", "a" * 3000})
    df = spark.createDataFrame([(w,) for w in words] + [(None,), ("a",)], "word string").repartition(3)
    table = spark.createDataFrame(list(vocab.items()), "token string, token_id long")
    want = {w: _python_walk(vocab, w) for w in words}
    for options in ({}, {"trie_chars": 10}):                    # the trie, then the join
        got = {r.word: (list(r.piece_ids) if r.known else None) for r in wp.segment_words(df, table, **options).collect()}
        assert got == want | {None: None}
    assert {(r.word, r.known) for r in wp.segment_words(df, table.filter("token_id < 0")).collect()} == {
        (w, False) for w in [*words, None]}


def test_one_piece_with_two_ids(spark):
    vocab = spark.createDataFrame([("▁a", 1), ("▁a", 7), ("▁a", 3)], "token string, token_id long")
    words = spark.createDataFrame([("a",)], "word string")
    assert [r.piece_ids for r in wp.segment_words(words, vocab).collect()] == [[7]]


def _limited(vocab, text, n_ctx, cls=1, sep=2):
    """Character by character: words are flushed at white space and punctuation, while there is room."""
    import string
    ids, word = [cls], ""

    def add(w):
        ids.extend(_python_walk(vocab, w) or [0])
    for c in text:
        if len(ids) >= n_ctx - 1:
            break
        if c in string.punctuation or c in " \t\n":
            if word:
                add(word)
            word = ""
            if c in string.punctuation:
                add(c)
        else:
            word += c
    if word and len(ids) < n_ctx - 1:
        add(word)
    return (ids + [sep])[:n_ctx]


def test_limited_ids(spark):
    import random
    rnd = random.Random(3)
    vocab = {wp.WORD_PREFIX + c: 10 + i for i, c in enumerate("abc.,")} | {c: 20 + i for i, c in enumerate("abc")}
    table = spark.createDataFrame(list(vocab.items()), "token string, token_id long")
    texts = ["", "a", "a.", "ab, c", "zz", "aaaaaaaaaaaa", ". . .", "abc.abc.abc.", " a  b\nc ", "a " * 500, "aaaaa" * 200]
    texts += ["".join(rnd.choices("abcz., ", k=rnd.randrange(40))) for _ in range(60)]
    docs = spark.createDataFrame([*enumerate(texts), (-1, None)], "id long, text string").repartition(3)
    for n_ctx in (2, 3, 8, 20):
        got = {r.id: (list(r.ids), r.whole) for r in wp.limited_ids(docs, table, n_ctx).collect()}
        for i, t in enumerate(texts):
            assert got[i][0] == _limited(vocab, t, n_ctx), (t, n_ctx)
            assert got[i][1] == (len(_limited(vocab, t, 10**6)) <= n_ctx)
        assert got[-1] == ([1, 2], True)


def test_tokens_get_their_pieces_in_place_and_as_by_the_join(spark):
    vocab = spark.createDataFrame([("▁a", 1), ("b", 2), ("▁b", 3), ("▁.", 4)], "token string, token_id long")
    toks = spark.createDataFrame([(i, j, ("a", "abb", "zz", "b", None)[(i + j) % 5]) for i in range(9) for j in range(7)],
                                 "id long, pos int, token string")
    docs = spark.createDataFrame([(1, "a ab. zz, b"), (1, "a"), (2, None), (3, "")], "id long, text string")
    ids = spark.range(10)
    made = (lambda n: wp.token_ids(toks, vocab, trie_chars=n), lambda n: wp.piece_profile(toks, ids, vocab, trie_chars=n),
            lambda n: wp.limited_ids(docs, vocab, 5, trie_chars=n))
    for make in made:
        here, joined = (sorted(map(str, make(n).collect())) for n in (wp.TRIE_CHARS, 0))
        assert here == joined
    plan = wp.token_ids(toks, vocab)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Aggregate" not in plan
