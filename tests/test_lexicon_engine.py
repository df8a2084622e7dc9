"""Acceptance vectors, invariants and tier equality of the lexicon engine."""

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tonglex import sql, streaming
from tonglex.functions.convert import Converter, Scripts
from tonglex.functions.text import classify, normalize
from tonglex.operators.lookup import (
    adjacent_dedup,
    chinese_index,
    english_tokens_join,
    query,
    query_by_chinese,
    query_by_english,
    query_by_pinyin,
    query_by_simplified,
    query_by_traditional,
    with_entries,
)
from tonglex.operators import packed

from tonglex.operators.segment import Segmenter, regex_tokens, tokenize_join
from tonglex.sources.lexicon import INDEX, Lexicon, seed


def english_matches(words, keys):
    """(place, words, key) of leftmost-longest matches of one to four words, by trying."""
    at = 0
    while at < len(words):
        take = next((n for n in range(min(4, len(words) - at), 0, -1) if "%20".join(words[at : at + n]) in keys), 0)
        if take:
            yield at, take, "%20".join(words[at : at + take])
        at += take or 1


@pytest.fixture(scope="module")
def lexicon(spark):
    return seed(spark).warm()


def texts(spark, *values):
    return spark.createDataFrame(list(enumerate(values)), "id long, t string")


def listed(hits, lexicon, field="traditional"):
    rows = with_entries(hits, lexicon).orderBy("id", "tok_pos", "idx_pos").collect()
    return [r["entry"][field] for r in rows]


def col(spark, f, *values):
    return [r[0] for r in texts(spark, *values).orderBy("id").select(f(F.col("t"))).collect()]


GENERAL = {
    " \t“watermelon”？\n": "watermelon", "hello,,world": "hello world", "ni、、hao。": "ni hao", "+ < = > ^ | ~": "+ < = > ^ | ~", "?!。，…": "",
    "Xi'an": "Xian", "'watermelon'": "watermelon", "lu:4": "lu 4", "a'b'c": "abc", "a''b": "a b",
}


def test_normalise(spark):
    assert col(spark, normalize, *GENERAL) == list(GENERAL.values())
    assert col(spark, lambda c: normalize(c, True), "Xi’an", "Xi1'an1", "lu:4.", "lu::4", None) == ["Xian", "Xi1an1", "lu:4", "lu: 4", None]


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(values=st.lists(st.text(alphabet="ab'’:u,. \t、好é", max_size=12), min_size=1, max_size=20))
def test_normalise_is_idempotent(spark, values):
    once = col(spark, normalize, *values)
    assert col(spark, normalize, *once) == once


def test_classify(spark):
    want = {"boat": "EN", "fán tǐ zì": "PY", "fan2ti3zi4": "PY", "jiantizi": "PY", "nihao": "PY", "简体字": "ZH", "繁體字": "ZH", "?!。，…": "UN", "": "UN", " ": "UN", "lu:4.": "PY", "watermelon": "EN", None: None}
    assert col(spark, classify, *want) == list(want.values())


def test_segmentation(spark, lexicon):
    keys = [r[0] for r in lexicon.headwords.collect()]
    want = {
        "今天的天氣挺爽": ["今天", "的", "天氣", "挺", "爽"], "今天的天气挺爽": ["今天", "的", "天气", "挺", "爽"],
        "红色是我favorite颜色。": ["红色", "是", "我", "颜色"], "今天天气不错": ["今天", "天气", "不错"], "": [], "xyz": [],
    }
    assert col(spark, lambda c: regex_tokens(c, keys), *want) == list(want.values())
    assert [Segmenter(keys).tokens(x) for x in want] == list(want.values())
    rows = tokenize_join(texts(spark, *want), "id", "t", lexicon.headwords).orderBy("id", "tok_pos").collect()
    assert [[r["token"] for r in rows if r["id"] == i] for i in range(len(want))] == list(want.values())


@settings(max_examples=300, deadline=None)
@given(word=st.lists(st.sampled_from(["xi", "an", "hua", "r", "dian", "1", "5", "g", "n", "v", "x", "e"]), max_size=8).map("".join))
def test_syllable_table_equals_a_pattern(word):
    import re

    from tonglex.functions import syllables
    from tonglex.plans.text_queries import PINYIN_WITH_R, PINYIN_WORD

    want = 1 if re.match(PINYIN_WORD, word) else 2 if re.match(PINYIN_WITH_R, word) else 0
    assert syllables.kind_of(word) == want


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(keys=st.lists(st.text(alphabet="ABC，.", min_size=1, max_size=4), max_size=6), values=st.lists(st.text(alphabet="ABC，. ", max_size=10), min_size=1, max_size=8))
def test_segmentation_tiers_agree(spark, keys, values):
    one = col(spark, lambda c: regex_tokens(c, keys), *values)
    assert one == [Segmenter(keys).tokens(x) for x in values]
    heads = spark.createDataFrame([(k,) for k in set(keys)], "key string")
    rows = tokenize_join(texts(spark, *values), "id", "t", heads).orderBy("id", "tok_pos").collect()
    assert one == [[r["token"] for r in rows if r["id"] == i] for i in range(len(values))]


def test_exact_lookups(spark, lexicon):
    assert listed(query_by_simplified(texts(spark, "龙纹"), "id", "t", lexicon), lexicon, "english") == [["dragon (as a decorative design)"]]
    assert listed(query_by_traditional(texts(spark, "繁體字"), "id", "t", lexicon), lexicon, "english") == [["traditional Chinese character"]]
    assert query_by_simplified(texts(spark, " 龙纹", None), "id", "t", lexicon).isEmpty()


def test_chinese_index_keeps_repeats_and_order(spark):
    rows = [("simplified", "a", 0, 3), ("simplified", "a", 1, 1), ("simplified", "a", 2, 3), ("traditional", "a", 0, 1), ("traditional", "a", 1, 2), ("traditional", "b", 0, 2), ("traditional", "b", 1, 2)]
    x = Lexicon(spark.createDataFrame([(1,), (2,), (3,)], "word_id long"), spark.createDataFrame(rows, INDEX))
    got = [(r["key"], r["word_id"]) for r in chinese_index(x).orderBy("key", "pos").collect()]
    assert got == [("a", 3), ("a", 1), ("a", 3), ("a", 2), ("b", 2), ("b", 2)]


def test_ambiguity_and_containment(spark, lexicon):
    ids = lambda f, x: {r["word_id"] for r in f(texts(spark, x), "id", "t", lexicon).collect()}
    assert len(ids(query_by_chinese, "万")) == 3
    assert ids(query_by_pinyin, "wan4") >= ids(query_by_traditional, "萬")
    assert ids(query_by_pinyin, "mo4") >= ids(query_by_traditional, "万")
    for p, s in (("yi3hou4", "以后"), ("yong4yu2", "用于"), ("she3bu5de5", "舍不得")):
        assert ids(query_by_pinyin, p) >= ids(query_by_simplified, s)
    for a in ("Xi'an", "Xi’an", "Xi1'an1", "Xī'ān"):
        assert "西安" in listed(query_by_pinyin(texts(spark, a), "id", "t", lexicon), lexicon)
    assert ids(query_by_pinyin, "lu:4.") == ids(query_by_pinyin, "lu:4") == ids(query_by_pinyin, "lǜ。") != set()


def test_pinyin_words_are_not_joined_or_deduplicated(spark, lexicon):
    assert listed(query_by_pinyin(texts(spark, "ni hao ni"), "id", "t", lexicon), lexicon) == ["你", "好", "你"]


def test_query(spark, lexicon):
    first = {"watermelon": "西瓜", "Watermelon": "西瓜", "to run": "執行", "people around the world": "人們", "你好今天的天气还好。": "你好", "hánlěng": "寒冷", "dian4nao3": "電腦", "nihao": "你好", "Beijing": "北京", "  people,around\t the  world. ": "人們"}
    t = texts(spark, *first, "?!。，…", "", "the lgbt+ community.", "zzz", None)
    rows = {r["id"]: r for r in query(t, "id", "t", lexicon).collect()}
    entry = {r["word_id"]: r["traditional"] for r in lexicon.entries.collect()}
    for i, want in enumerate(first.values()):
        assert entry[rows[i]["hits"][0]["word_id"]] == want
    n = len(first)
    assert rows[n]["hits"] is None and rows[n + 1]["hits"] is None and rows[n]["label"] == "UN"
    assert rows[n + 2]["hits"] and rows[n + 3]["hits"] == [] and rows[n + 4]["hits"] is None


def test_query_answers_every_row(spark, lexicon):
    rows = [(1, "watermelon"), (1, "people"), (None, "watermelon"), (None, None), (2, "zzz"), (2, "zzz"), (None, "?"), (3, "你好")]
    t = spark.createDataFrame(rows, "id long, t string")
    entry = {r["word_id"]: r["traditional"] for r in lexicon.entries.collect()}
    found = lambda x: sorted(((r["id"], r["label"], None if r["hits"] is None else [entry[h["word_id"]] for h in r["hits"]]) for r in query(t, "id", "t", x).collect()), key=repr)
    want = [(1, "EN", ["西瓜"]), (1, "EN", ["人們"]), (None, "EN", ["西瓜"]), (None, None, None), (2, "EN", []), (2, "EN", []), (None, "UN", None), (3, "ZH", ["你好"])]
    assert found(lexicon) == sorted(want, key=repr)
    large = Lexicon(lexicon.entries, lexicon.index)
    large.small = lambda: False  # the tier of joins
    assert found(large) == sorted(want, key=repr)


def test_syllables(spark):
    from tonglex.functions import syllables
    from tonglex.plans.text_queries import FINALS

    own = syllables.syllables()
    assert own == {i + f for f, initials in FINALS.items() for i in initials.split(" ")} and len(own) == 412
    want = dict.fromkeys(["fire", "fine", "life", "tin", "din", "fibula"], "EN") | dict.fromkeys(["nv3", "lǜ", "women", "xiong2mao1", "zhuang"], "PY")
    # with r; a bare one needs company
    want |= dict.fromkeys(["huar3", "yi dianr", "yì diǎnr", "diǎnr", "hua1 r5", "hua1r5", "r5", "zher4 nar3", "nihao" * 20, "xi1an1" * 5000], "PY")
    want |= dict.fromkeys(["hair", "your hair", "her", "a car", "r", "nihao" * 20 + "x", "yi dianrr", "dianr5r"], "EN")
    assert col(spark, classify, *want) == list(want.values())


def test_english_tiers_and_adjacent_dedup(spark, lexicon):
    t = texts(spark, "to run to run", "watermelon, watermelon and to%20run", "people to run good good you", "", None)
    one = query_by_english(t, "id", "t", lexicon).orderBy("id", "tok_pos", "idx_pos").collect()
    index = lexicon.index.where("kind = 'english'").select("key", "pos", "word_id")
    tokens = english_tokens_join(t, "id", normalize(F.col("t")), index)
    two = tokens.join(index, tokens["token"] == index["key"]).select("id", "tok_pos", F.col("pos").alias("idx_pos"), "word_id")
    assert one == adjacent_dedup(two, "id").orderBy("id", "tok_pos", "idx_pos").collect()
    assert sum(r["id"] == 0 for r in one) == 1
    assert list(english_matches("a b c d e".split(), {"a%20b%20c%20d", "b", "e"})) == [(0, 4, "a%20b%20c%20d"), (4, 1, "e")]


def keys_of(ids):
    import pyarrow as pa

    rows = [(k, p, i) for k, own in ids.items() for p, i in enumerate(own)]
    return packed.Keys.of(pa.table({"key": pa.array([r[0] for r in rows], pa.string()), "pos": pa.array([r[1] for r in rows], pa.int32()), "word_id": pa.array([r[2] for r in rows], pa.int64())}))


@settings(max_examples=300, deadline=None)
@given(
    ids=st.dictionaries(st.lists(st.sampled_from(["a", "b", "c%20", "%20"]), min_size=1, max_size=5).map("%20".join), st.lists(st.integers(1, 4), min_size=1, max_size=3), max_size=8),
    texts=st.lists(st.lists(st.sampled_from(["a", "b", "c%20", "a%20b", "%20", "d"]), max_size=9).map(" ".join), max_size=5),
)
def test_packed_lookups_equal_trying(ids, texts):
    keys = keys_of(ids)
    rows = lambda h: list(zip(h.row.tolist(), h.token.tolist(), h.place.tolist(), h.word.tolist(), strict=True))
    split = [[w for w in t.split(" ") if w] for t in texts]
    want = []
    for r, ws in enumerate(split):
        found = [(r, at, i, word) for at, _, key in english_matches(ws, ids) for i, word in enumerate(ids[key])]
        want += [h for k, h in enumerate(found) if k == 0 or found[k - 1][3] != h[3]]
    assert rows(packed.english(texts, keys)) == want
    assert rows(packed.pinyin(texts, keys)) == [(r, at, i, word) for r, ws in enumerate(split) for at, w in enumerate(ws) for i, word in enumerate(ids.get(w, ()))]


@settings(max_examples=200, deadline=None)
@given(keys=st.sets(st.text(alphabet="ab中", min_size=1, max_size=5), max_size=12), texts=st.lists(st.text(alphabet="ab中 ", max_size=30), max_size=4))
def test_automaton(keys, texts):
    from tonglex.functions.automaton import Automaton

    walk, order = Automaton.build(keys), sorted(keys)
    assert walk.find(order).tolist() == list(range(len(order))) and set(walk.find(["", "x", "aaaaaaa"]).tolist()) == {-1}
    assert Automaton(walk.buffer).find(order).tolist() == list(range(len(order)))
    segmenter = Segmenter(keys)
    for t in texts:
        want, at = [], 0
        while at < len(t):
            longest = max((k for k in keys if t.startswith(k, at)), key=len, default=None)
            want += [longest] if longest else []
            at += len(longest or "x")
        assert segmenter.tokens(t) == want


def test_automaton_shares_endings():
    from tonglex.functions.automaton import Automaton

    walk = Automaton.build([a + b for a in "abcdefgh" for b in ("tion", "ing", "ed")])
    assert len(walk.ends) == 9 and (walk.moves >= 0).sum() == 8 + 9


def test_conversion(spark, lexicon):
    s = Scripts(lexicon.pairs())
    assert col(spark, s.simplified_to_traditional, "繁体字", None) == ["繁體字", None]
    assert col(spark, s.traditional_to_simplified, "簡體字") == ["简体字"]
    assert col(spark, s.is_simplified, "简体字", "簡體字") == [True, False]
    assert col(spark, s.is_traditional, "繁體字", "繁体字") == [True, False]
    phrases = Converter([("ab", "x"), ("a", "y"), ("a", "z")])
    assert not phrases.regular and col(spark, phrases, "aba", "") == ["xy", ""]


def test_lexicon_checks_and_round_trip(spark, lexicon, tmp_path):
    lexicon.check()
    one = lexicon.write(str(tmp_path))
    small = Lexicon(lexicon.entries.where("word_id < 5"), lexicon.index.where("word_id < 5 and kind = 'traditional'"))
    assert small.write(str(tmp_path)) != one and Lexicon.read(spark, str(tmp_path)).entries.count() == 4
    assert Lexicon.read(spark, str(tmp_path), version=one).entries.count() == lexicon.entries.count()
    lexicon.entries.write.parquet(str(tmp_path / "v-half" / "entries"))  # a writer that failed before its index
    assert Lexicon.read(spark, str(tmp_path)).entries.count() == 4
    with pytest.raises(FileNotFoundError):
        Lexicon.read(spark, str(tmp_path / "none"))
    lexicon.write(str(tmp_path))
    back = Lexicon.read(spark, str(tmp_path))
    assert back.entries.exceptAll(lexicon.entries).isEmpty() and back.index.count() == lexicon.index.count()
    with pytest.raises(ValueError, match="dangling"):
        Lexicon(lexicon.entries, spark.createDataFrame([("english", "x", 0, 999)], INDEX)).check()


def test_sql_names_and_streams(spark, lexicon, tmp_path):
    sql.register(spark, lexicon, "t_")
    assert spark.sql("select t_tokenize('今天天气不错'), t_is_traditional('繁體字'), t_traditional_to_simplified('簡體字')").first() == (["今天", "天气", "不错"], True, "简体字")
    texts(spark, "watermelon", "你好").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id long, t string").parquet(str(tmp_path / "in"))
    q = streaming.english_lookup(streaming.classified(stream, "t"), "t", lexicon).writeStream.format("memory").queryName("found").start()
    q.processAllAvailable()
    q.stop()
    assert {(r["label"], len(r["hits"])) for r in spark.table("found").collect()} == {("EN", 1), ("ZH", 0)}


def test_sql_names_of_texts_and_lookups(spark, lexicon):
    sql.register(spark, lexicon, "nm_")
    t = texts(spark, *GENERAL, "watermelon", "fire", "ni3 hao3", "lu:4", "西瓜，你好！", "to run boat", "?!", "", None, "1 ni", "Xi'an")
    t.createOrReplaceTempView("nm_texts")
    got = spark.sql("SELECT id, nm_normalize(t) AS n, nm_normalize_pinyin(t) AS np, nm_classify(t) AS label, nm_query(t) AS hits FROM nm_texts").orderBy("id").collect()
    want = t.select("id", normalize(F.col("t")), normalize(F.col("t"), True)).orderBy("id").collect()
    assert [tuple(r)[:3] for r in got] == [tuple(r) for r in want]
    assert [tuple(r) for r in spark.sql("SELECT id, nm_classify(t), nm_query(t) FROM nm_texts").orderBy("id").collect()] == [tuple(r) for r in query(t, "id", "t", lexicon).orderBy("id").collect()]


def test_query_with_entries_and_by_joins(spark, lexicon):
    t = texts(spark, "watermelon boat", "西瓜你好", "ni3 hao3", "to run people hello hello", "?!", None, "zzz")
    with_them = query(t, "id", "t", lexicon, entries=True).orderBy("id").collect()
    assert with_them[0]["hits"][0]["entry"]["traditional"] == "西瓜" and with_them[4]["hits"] is None and with_them[6]["hits"] == []
    plain = query(t, "id", "t", lexicon).orderBy("id").collect()
    assert [[h["word_id"] for h in r["hits"] or ()] for r in with_them] == [[h["word_id"] for h in r["hits"] or ()] for r in plain]
    large = Lexicon(lexicon.entries, lexicon.index, broadcast_rows=0)
    assert not large.small() and query(t, "id", "t", large).orderBy("id").collect() == plain


def test_stream_takes_a_new_lexicon_and_restarts(spark, lexicon, tmp_path):
    store, source, out, log = (str(tmp_path / d) for d in ("store", "in", "out", "log"))
    less = Lexicon.of(lexicon.entries.where("traditional <> '西瓜'"))
    versions = [less.write(store)]
    run = lambda: streaming.answered(spark.readStream.schema("id long, t string").parquet(source), "id", "t", store, out, log, availableNow=True).awaitTermination()
    texts(spark, "watermelon", "people").write.parquet(source)
    run()
    versions.append(lexicon.write(store))
    texts(spark, "watermelon", None).write.mode("append").parquet(source)
    run()
    found = lambda: sorted((r["id"], len(r["hits"] or ()), versions.index(r["version"]), r["batch"]) for r in spark.read.parquet(out).collect())
    want = [(0, 0, 0, 0), (0, 1, 1, 1), (1, 0, 1, 1), (1, 1, 0, 0)]
    assert found() == want
    # the driver fails after a batch's rows were written and before Spark knew: the batch runs again, by its version of then
    import os

    os.remove(f"{log}/commits/1")
    if os.path.exists(f"{log}/commits/.1.crc"):
        os.remove(f"{log}/commits/.1.crc")
    versions.append(less.write(store))
    run()
    assert found() == want
    run()
    assert found() == want


@pytest.mark.parametrize("clean", ["watermelon", "people", "ni hao", "nǐ hǎo", "ni3 hao3", "lǜ", "你好", "the lgbt+ community"])
def test_separators_around_and_between_words_change_nothing(spark, lexicon, clean):
    around = [("", x) for x in ".?,。？，"] + [('"', '"'), ("“", "”"), ("「", "」"), ("  ", "…!"), ("¿", " ?")]
    made = [a + clean + b for a, b in around] + [clean.replace(" ", x) for x in (",", "。 ", " - ", "/") if " " in clean]
    rows = [tuple(r)[1:] for r in query(texts(spark, clean, *made), "id", "t", lexicon).orderBy("id").collect()]
    assert rows[0][1] and all(r == rows[0] for r in rows)


def test_entries_have_ids_of_their_own(spark, lexicon):
    assert lexicon.entries.count() == lexicon.entries.select("word_id").distinct().count()
    for kind in ("simplified", "traditional"):
        hits = query_by_simplified(lexicon.headwords.withColumn("id", F.col("key")), "id", "key", lexicon, kind)
        assert hits.count() == hits.distinct().count() > 30


def test_conversion_by_joins_equals_in_place(spark, lexicon):
    import random
    from decimal import Decimal

    from tonglex.operators.rewrite import converted
    from tonglex.sources.lexicon import ENTRY

    rng = random.Random(2)
    word = lambda abc, n: "".join(rng.choices(abc, k=rng.randint(1, n)))
    made = [(word("甲乙丙ab", 3), word("甲丁戊ab", 3), "x", "x", ["x"], [], Decimal(i), [], rng.randint(1, 3), i) for i in range(40)]
    one = Lexicon.of(spark.createDataFrame(made, ENTRY))
    large = Lexicon(one.entries, one.index, broadcast_rows=0)
    t = texts(spark, None, "", "zz", *("".join(rng.choices("甲乙丙丁戊ab ", k=rng.randint(0, 60))) for _ in range(60))).unionByName(spark.createDataFrame([(None, "甲乙"), (3, "丁戊")], "id long, t string"))
    for to in ("simplified", "traditional"):
        rows = [sorted(map(str, converted(t, "id", "t", x, to).collect())) for x in (one, large)]
        assert rows[0] == rows[1] and len(rows[0]) == 65
    with pytest.raises(ValueError, match="script"):
        converted(t, "id", "t", one, "cursive")


def test_dictionary_text(spark, tmp_path):
    from tonglex.sources import dictionary

    good = ["電腦 电脑 [dian4 nao3] /computer/", "綠 绿 [lu:4] /green/", "西瓜 西瓜 [xi1 gua1] /watermelon/melon of the west/", "好 好 [hao3] /good/", "朵兒 朵儿 [duo3 r5] /flower/", "優 优 [You1] /fine/"]
    bad = ["no brackets here", "西瓜 西瓜 [xi1 gua1]", "一 [yi1] /one/"]
    lines = ["# a remark", good[0], bad[0], "", *good[1:4], bad[1], good[4] + "\r", bad[2], good[5]]
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "one.u8").write_text("\n".join(lines), encoding="utf-8")
    (tmp_path / "d" / "two.u8").write_bytes(b"\xff\xfe [x] /y/\n")
    (tmp_path / "d" / "_ignored").write_text("x")
    dictionary.register(spark)
    for split in (1, 7, 40, 1 << 20):
        got = spark.read.format("dictionary_text").option("split_bytes", split).load(str(tmp_path / "d")).collect()
        assert sorted(r["traditional"] for r in got if r["damaged"] is None) == sorted(g.split()[0] for g in good)
        assert sorted(r["damaged"] for r in got if r["damaged"] and "\ufffd" not in r["damaged"]) == sorted(bad) and len(got) == 10
    e = dictionary.entries_of(spark.read.format("dictionary_text").load(str(tmp_path / "d")))
    assert {r["pinyin_marks"] for r in e.collect()} == {"diàn nǎo", "lǜ", "xī guā", "hǎo", "duǒ r", "Yōu"}
    x = Lexicon.of(e)
    x.check()
    assert [len(r["hits"]) for r in query(texts(spark, "watermelon", "电脑", "lu:4", "dian4nao3"), "id", "t", x).orderBy("id").collect()] == [1, 1, 1, 1]
    (tmp_path / "none").mkdir()
    assert spark.read.format("dictionary_text").load(str(tmp_path / "none")).count() == 0


def test_small_splits_share_tasks_and_read_little(spark, tmp_path):
    import io

    from tonglex.sources import dictionary

    lines = [f"字{i} 字{i} [zi4 {i}] /{'gloss ' * (i % 9)}{i}/" for i in range(3000)]
    for k in range(3):
        (tmp_path / f"{k}.u8").write_text("\n".join(lines[k::3]), encoding="utf-8")
    reader = dictionary.Reader(str(tmp_path), 32)
    tasks = reader.partitions()
    assert 100 < len(tasks) <= dictionary.TASKS  # of thousands of splits
    dictionary.register(spark)
    got = spark.read.format("dictionary_text").option("split_bytes", 32).load(str(tmp_path)).collect()
    assert sorted(r["traditional"] for r in got) == sorted(line.split()[0] for line in lines) and len({(r["file"], r["place"]) for r in got}) == 3000
    assert len(dictionary.Reader(str(tmp_path), 1 << 20).partitions()) == 3

    class Counted(io.BytesIO):
        taken = 0

        def read(self, n=-1):
            data = super().read(n)
            self.taken += len(data)
            return data

    file = Counted((tmp_path / "0.u8").read_bytes() * 50)
    assert len(list(dictionary._lines(file, 4096, 8192))) > 10 and file.taken < 6000
    long = Counted(b"a\n" + b"b" * 3_000_000 + b"\nc\n")
    assert [len(x) for _, x in dictionary._lines(long, 1, 10)] == [3_000_000] and [x for _, x in dictionary._lines(long, 10, 4_000_000)] == [b"c"]
