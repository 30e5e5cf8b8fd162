import itertools
import random

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from tallyweave.llm import gazetteer, history, languages, linkage, lookalikes, mixing, mojibake, packing

# ---------------------------------------------------------------- history


def test_graph_finds_what_exhaustive_search_finds():
    rng = np.random.RandomState(1)
    numbers = np.array(["".join(rng.choice(list("0123456789"), 20)) for _ in range(3000)], object)
    cents, minutes = rng.randint(1, 900, 3000), rng.randint(28_000_000, 28_000_300, 3000)
    v = history.vectors(numbers, cents, minutes, np.zeros(3000, bool))
    beam, recall = history.tuned_beam(history.Shard(v), v, 0.1)
    got = set(zip(*(x.tolist() for x in history.Shard(v).search(v[:300], beam, 0.1))))
    truth = history.exhaustive(v, v[:300], 0.1)
    assert recall >= 0.99 and len(got & truth) >= 0.99 * len(truth)


def test_numbers():
    alike = history.numbers_alike
    assert alike("24642088939527844484", "24642088939527B44484") and alike("24152014169386743392", "2415201416938674392") and alike("2024041622564", "2024014622564")
    assert alike("2024022122104836347867487492", "2024022122104836347867487492*529") is False and alike("24492047437532049058", "24402072052354567926") is False
    assert alike("2024033122615282993216332274", "2.02403E+27") is None and alike("2025033122615282993216332274", "2.02403E+27") is False


def test_near_is_the_bounded_distance():
    rng = random.Random(6)
    for _ in range(3000):
        x = "".join(rng.choice("0123AB") for _ in range(rng.randint(0, 12)))
        y = list(x) if rng.random() < 0.7 else [rng.choice("0123AB") for _ in range(rng.randint(0, 12))]
        for _ in range(rng.randint(0, 4)):
            k = rng.randint(0, len(y))
            y[k : k + rng.randint(0, 2)] = rng.choice([[], ["1"], ["A", "0"], y[k : k + 2][::-1]])
        most = rng.randint(0, 4)
        assert history.near(x, "".join(y), most) == (gazetteer.distance(x, "".join(y)) <= most), (x, y)


def test_one_number(spark):
    from pyspark.sql import functions as F

    for a, b in {"No. 123": "123", "'123": "123", "1 2-3.": "123", "000123": "123", "１２３": "123", "1​23　": "123", "𝟐𝟒": "24", "ЕЕ-1": "EE1", "NO: 5": "5"}.items():
        assert spark.range(1).select(history.one_number(F.lit(a)).alias("x")).first()["x"] == b


@pytest.mark.parametrize("hot", [50_000, 3])
def test_same_rows(spark, monkeypatch, hot):
    monkeypatch.setattr(history, "HOT", hot)
    f = "payment.transaction_id"
    rows = [(f, 1, "20240101123456", 500, 100, "甲店"), (f, 2, "20240101123456", 500, 100, "甲店"), (f, 3, "20240101123457", 500, 100, "甲店"), (f, 4, "20240101999999", 700, 100, "甲店"), (f, 5, "20240101123456", 1, 9, None), (f, 6, "2.02401E+13", 500, 100, "乙"), (f, 7, "2.02401E+13", 500, 100, "甲店")]
    rows += [(f, 10 + k, "77777777777777", 900, None, "丙") for k in range(12)]
    got = sorted(tuple(r)[1:] for r in history.same_rows(spark.createDataFrame(rows, "field string, seq bigint, number string, cents bigint, minute bigint, name string")).collect())
    assert got == [(1, 2), (1, 3), (1, 5), (1, 7)] + [(10, 10 + k) for k in range(1, 12)]


def brute_force(number, name, seq, node):
    """The first same node of each row by comparing all pairs with the same rule."""
    out = {}
    for j in range(len(seq)):
        for i in np.nonzero(node & (seq < seq[j]))[0]:
            x, y = number[i], number[j]
            alike = (None if history.CUT.match(x) else False) if x == y else history.numbers_alike(x, y)
            if alike or alike is None and history.names_alike(name[i], name[j]):
                out[int(seq[j])] = min(int(seq[i]), out.get(int(seq[j]), int(seq[i])))
    return out


def damaged(rng, x):
    k = rng.randrange(1, len(x) - 1)
    return rng.choice([x[:k] + x[k + 1] + x[k] + x[k + 2 :], x[:k] + x[k + 1 :], x[:k] + "B" + x[k:], x[:k] + "7" + x[k + 1 :], x[:12], x[-11:], f"{x[0]}.{x[1:6]}E+{len(x) - 1}", x + "*52", x[:k] + x[k + 2 :] + "31"])


def hot_group(n, seed=4):
    """Different numbers of one amount and time, and damaged copies of a tenth of them, later."""
    rng = random.Random(seed)
    plain = ["24" + "".join(rng.choice("0123456789") for _ in range(18)) for _ in range(n)]
    return plain + [damaged(rng, x) for x in plain[: n // 10]]


def test_large_keys_are_compared_exactly():
    number = np.array(hot_group(120), object)
    rng = random.Random(5)
    name = np.array([rng.choice(["甲店", "乙馆", None]) for _ in number], object)
    seq = np.arange(len(number))
    for node in (np.ones(len(number), bool), np.arange(len(number)) % 2 == 0):
        a, b = history.links_of_key(number, name, seq, node)
        assert dict(zip(b.tolist(), a.tolist())) == brute_force(number, name, seq, node)


def test_a_hot_amount_and_time_loses_no_copy():
    number = np.array(hot_group(2500), object)
    g = pd.DataFrame({"number": number, "key": 1, "name": None, "seq": np.arange(len(number)), "node": True, "cents": 100, "minute": 50})
    got = pd.concat(history._search_group("f", history.NEAR, g)).groupby("seq_b").seq_a.min()
    for j in range(2500, len(number)):
        if number[j - 2500] != number[j] and history.numbers_alike(number[j - 2500], number[j]):
            assert got.get(j, j) <= j - 2500


def test_distances_in_columns():
    rng = random.Random(6)
    words = ["".join(rng.choice("abc") for _ in range(rng.randint(1, 9))) for _ in range(600)]
    codes = np.ascontiguousarray(np.array(words, "U12")).view(np.uint32).reshape(-1, 12)
    size = np.array([len(w) for w in words], np.int16)
    i, j = np.arange(0, 600, 2), np.arange(1, 600, 2)
    got = history.distances(codes[i].T, codes[j].T, size[i], size[j])
    assert np.minimum(got, 5).tolist() == [min(5, gazetteer.distance(words[a], words[b])) for a, b in zip(i, j)]


def test_shards_tune_again_and_fall_back(monkeypatch):
    rng = np.random.RandomState(1)
    n = 4 * 600
    numbers = np.array(["".join(rng.choice(list("0123456789"), 20)) for _ in range(n)], object)
    key = rng.randint(0, n // 8, n)
    v = history.vectors(numbers, key, np.zeros(n, int), np.zeros(n, bool))
    monkeypatch.setattr(history, "RECALL", 1.1)  # no beam reaches it
    shards = history.Shards(0.1, key)
    for lo in range(0, n, 600):
        part = np.arange(lo, lo + 600)
        shards.add(part, v[part])
        got = {(int(x), int(y)) for a, b in shards.search(part, v[part]) for x, y in zip(part[a], b)}
        assert got >= {(int(x), int(y)) for x in part for y in np.nonzero(key[: lo + 600] == key[x])[0]}
    assert len(shards.levels) == 1 and shards.levels[0][3]["beam"] is None


@pytest.mark.parametrize("large", [32, 2])
def test_index_finds_batch_by_batch_what_one_run_finds(spark, monkeypatch, tmp_path, large):
    monkeypatch.setattr(history, "LARGE", large)
    rng = random.Random(9)
    f = "payment.transaction_id"
    rows = []
    for k in range(400):
        if rows and rng.random() < 0.35:
            x = list(rng.choice(rows)[2])
            if rng.random() < 0.6:
                x[rng.randrange(len(x))] = rng.choice("0123456789B")
            number = "".join(x)
        else:
            number = "".join(rng.choice("0123456789") for _ in range(16))
        rows.append((f, k, number, rng.randint(1, 3) * 100, rng.choice([5, 6, None]), rng.choice(["甲店", "乙店", None])))
    schema = "field string, seq bigint, number string, cents bigint, minute bigint, name string"
    all_ = spark.createDataFrame(rows, schema)
    want = sorted(tuple(r) for r in history.same_rows(all_).collect())
    index = history.Index(spark, f"file://{tmp_path}/index")
    parent = {}
    for b in range(5):
        batch = spark.createDataFrame(rows[b * 80 : (b + 1) * 80], schema)
        parent |= {r["seq_b"]: r["seq_a"] for r in index.check(batch).collect()}
        index.add(f"B{b}", batch)
        index.add(f"B{b}", batch)  # once more: replaced, not stored twice
        index.compact()
    assert len(index.parts()) < 5 and index.shards().selectExpr("sum(rows)").first()[0] == index._rows(all_).count()

    def top(s):
        while s in parent:
            s = parent[s]
        return s

    assert sorted((f, top(s), s) for s in parent) == want


# ---------------------------------------------------------------- garbled text


def test_round_trips():
    names = ["松寨市羊河票务代理有限公司", "山林大酒店", "平台商户_桐琴榆小馆", "羊龙·面馆", "龙舟（云渡）公交乘车码", "小织家面摊"]
    pool = names * 40 + ["Café Bruyon", "Müller Gästehaus"]
    counts = {}
    for n in pool:
        for c in set(n):
            counts[c] = counts.get(c, 0) + 1
    usual = mojibake.Usual(counts, len(pool))
    done = 0
    for name in names:
        for right, wrong in [("utf-8", "latin-1"), ("utf-8", "cp437"), ("utf-8", "koi8-r"), ("utf-8", "mac-roman"), ("gbk", "latin-1"), ("gbk", "cp1251"), ("gbk", "big5")]:
            try:
                bad = name.encode(right).decode(wrong)
            except UnicodeError:
                continue
            done += 1
            assert mojibake.restore(bad, usual) == name, (bad, right, wrong)
    assert done > 20
    twice = "山林大酒店".encode().decode("latin-1").encode().decode("latin-1")
    assert mojibake.restore(twice, usual) == "山林大酒店"
    assert mojibake.restore("松寨市" + "羊河票务".encode().decode("latin-1"), usual) == "松寨市羊河票务"
    assert mojibake.restore("山林��店", usual) == "" and mojibake.restore("山林大酒店", usual) is None and mojibake.restore("Café Bruyon", usual, {"Café Bruyon"}) is None
    assert mojibake.restore("", usual) is None and mojibake.restore("Where To? Tours", usual) is None
    four = "㐀山林大酒店"  # its first character has four bytes in GB18030
    assert mojibake.restore(four.encode("gb18030").decode("latin-1"), mojibake.Usual(counts | {"㐀": 9}, len(pool))) == four
    again = "山林大酒店"
    for _ in range(5):
        again = again.encode().decode("cp1252", "replace") if "\x81" in again else again.encode().decode("latin-1")
    assert mojibake.restore(again, usual) == "山林大酒店"


@pytest.mark.parametrize("right", ["big5", "cp949", "cp932", "euc-jp", "gb18030"])
def test_every_pair_of_encodings(right):
    names = ["山林大酒店", "大山公司本店", "高中大人天地", "小人日月山水"]
    counts = {c: 40 for n in names for c in n}
    usual = mojibake.Usual(counts, 200)
    done = ok = 0
    for name in names:
        for wrong in ("cp437", "koi8-r", "cp1251", "cp866", "latin-1", "mac-roman", "big5", "gb18030"):
            try:
                bad = name.encode(right).decode(wrong)
            except UnicodeError:
                continue
            if wrong != right:
                done += 1
                ok += mojibake.restore(bad, usual) == name
    assert done > 8 and ok >= 0.8 * done
    assert mojibake.restore("Τea-Break Kiosk 24", usual) is None and mojibake.restore("Cоpper Spoon", usual) is None


# ---------------------------------------------------------------- look-alikes


def test_one_form(spark):
    pairs = {"ＶＩＰ": "VIP", "VΙР": "VIP", "Café": "Café", "Α̈rzte": "Ärzte", "a​b\xadc": "abc", "a\xa0 b　": "a b", "⾦岭": "金岭", "⻰小‧停车": "龙小·停车", "（甲）": "(甲)", "​": "", "ẹ́": "ẹ́", "한빛": "한빛"}
    df = spark.createDataFrame([(k,) for k in pairs] + [(None,)], "t string").filter("t is not null")
    got = {r["t"]: r["clean"] for r in df.select("t", *lookalikes.text_id("t")).join(lookalikes.one_form(df, "t"), ["t1", "t2"]).collect()}
    import unicodedata

    for a, b in pairs.items():
        assert unicodedata.normalize("NFC", got[a]) == unicodedata.normalize("NFC", b), a


# ---------------------------------------------------------------- places


def plain_distance(a, b):
    """Unrestricted Damerau-Levenshtein by the textbook: shortest path over single edits is bounded by Levenshtein."""
    from functools import lru_cache

    @lru_cache(None)
    def go(i, j):
        if not i or not j:
            return i + j
        best = min(go(i - 1, j) + 1, go(i, j - 1) + 1, go(i - 1, j - 1) + (a[i - 1] != b[j - 1]))
        for k in range(1, i):
            for m in range(1, j):
                if a[i - 1] == b[m - 1] and a[k - 1] == b[j - 1]:
                    best = min(best, go(k - 1, m - 1) + (i - k - 1) + 1 + (j - m - 1))
        return best

    return go(len(a), len(b))


def test_distance_and_tree():
    rng = random.Random(2)
    words = list({"".join(rng.choice("abc") for _ in range(rng.randint(1, 6))) for _ in range(120)})
    for _ in range(200):
        a, b, c = rng.choice(words), rng.choice(words), rng.choice(words)
        assert gazetteer.distance(a, b) == plain_distance(a, b)
        assert gazetteer.distance(a, c) <= gazetteer.distance(a, b) + gazetteer.distance(b, c)
    tree = gazetteer.BKTree(words)
    for q in words[:30]:
        assert tree.within(q, 2) == sorted((plain_distance(q, w), w) for w in words if plain_distance(q, w) <= 2)


REF = [(1, "素原省", "province", None, None, None), (2, "青麓市", "city", "素原省", "Qinglu", "QGU"), (3, "云湾市", "city", "碧海省", "Yunwan", "YWN"), (4, "云湾港市", "city", "棠北省", None, None), (5, "碧海省", "province", None, None, None), (6, "Norvikstad", "city", None, "Norvikstad", "NOD"), (7, "云陵市", "city", "素原省", "Yunling", None), (8, "云陵市", "city", "碧海省", None, None), (9, "棠北省", "province", None, None, None)]


def test_places(spark):
    want = {"青麓南站": 2, "素原省青丿市": 2, "靑麓": 2, "QINGLU": 2, "qgu": 2, "Qing Lu": 2, "Q i n g l u": 2, "Qniglu": 2, "云湾港国际机场": 4, "云湾市高新区": 3, "碧海省·云陵市": 8, "云陵": 7, "素原(全省)": 1, "Norvikstad, Downtown": 6, "Norrvikstad": 6, "境外": -1, "12345": -1, "喀什伦堡": -1, "　云湾 市": 3, "长" * 50_000: -1}
    ref = spark.createDataFrame(REF, "place_id int, name string, kind string, province string, latin_name string, code string")
    values = spark.createDataFrame([(v,) for v in want], "value string")
    for limit in (50_000, 4):  # broadcast, then in shards
        got = {r["value"]: r["place_id"] for r in gazetteer.match(values, "value", ref, limit).collect()}
        assert got == want, limit


def test_sharded_gazetteer_equals_one_tree(spark):
    rng = random.Random(8)
    ends = ["市", "县", "", "州"]
    provinces = [(k, x + "省", "province", None, None, None) for k, x in enumerate(["江苏", "江西", "云", "云南"])]
    cities = [(10 + k, "".join(rng.choice("苏州洲南京云江") for _ in range(rng.randint(1, 3))) + rng.choice(ends), "city", rng.choice(provinces)[1], f"Latin{rng.choice('abc')}{k % 7}", None) for k in range(40)]
    kind = "place_id int, name string, kind string, province string, latin_name string, code string"
    ref = spark.createDataFrame(provinces + cities, kind)
    words = ["".join(rng.choice(["江苏省", "云", "云南省", "苏", "州", "洲", "南", "京", "机场", "东站", "市", "县"]) for _ in range(rng.randint(1, 4))) for _ in range(600)] + ["Latina1", "latinb", "Latinc3 airport", "江苏省苏洲县", "云" * 3000]
    values = spark.createDataFrame([(w,) for w in set(words)], "value string")
    one = {r["value"]: r["place_id"] for r in gazetteer.match(values, "value", ref).collect()}
    for limit in (20, 4):
        assert {r["value"]: r["place_id"] for r in gazetteer.match(values, "value", ref, limit).collect()} == one
    assert len(set(one.values())) > 10


def test_plain_twins():
    assert lookalikes.plain_twins(["立峰面馆（渭湾店）", "Café ロ", "甲－乙"]) == "()-口"


# ---------------------------------------------------------------- packing and mixing


@pytest.mark.parametrize("capacity", [50, 100, 400])
def test_packing(capacity):
    rng = random.Random(capacity)
    sizes = sorted((rng.randint(1, capacity) for _ in range(300)), reverse=True)
    windows = packing.pack(sizes, capacity)
    assert sorted(itertools.chain(*windows)) == list(range(300)) and max(sum(sizes[i] for i in w) for w in windows) <= capacity
    assert len(windows) <= 1.1 * -(-sum(sizes) // capacity) + 1 and packing.pack([], 10) == [] and sorted(packing.pack([capacity] * 3, capacity)) == [[0], [1], [2]]


def test_differencing_is_near_equal():
    rng = random.Random(3)
    sums = [w[0] for w in packing.differencing(sorted((rng.randint(1, 100) for _ in range(200)), reverse=True), 10)]
    assert len(sums) == 10 and max(sums) - min(sums) <= 2


def test_containers(spark):
    sizes = spark.createDataFrame([(1, 1100), (2, 0), (3, 300), (4, 212), (5, 512), (6, None)], "doc_id bigint, tokens bigint")
    rows = packing.containers(sizes, spark.createDataFrame([("s", 512)], "container_kind string, capacity_tokens int")).collect()
    assert sum(r["tokens"] for r in rows) == 2124 and sorted((r["doc_id"], r["piece_no"], r["token_from"], r["tokens"]) for r in rows)[:3] == [(1, 0, 0, 512), (1, 1, 512, 512), (1, 2, 1024, 76)]
    fill = {}
    for r in rows:
        fill[r["container_id"]] = fill.get(r["container_id"], 0) + r["tokens"]
    assert max(fill.values()) <= 512


def test_budgets_and_mix(spark):
    leaves = [{"key": ("a", "zh", "x"), "weight": 0.5, "cap": 10}, {"key": ("a", "zh", "y"), "weight": 0.2, "cap": 100}, {"key": ("b", "zh", "z"), "weight": 0.3, "cap": 100}]
    assert mixing.budgets(leaves, 100) == pytest.approx({("a", "zh", "x"): 10, ("a", "zh", "y"): 60, ("b", "zh", "z"): 30})
    rng = random.Random(1)
    docs = spark.createDataFrame([(k, "zh" if k % 2 else None, "bill_note" if k % 10 else "toll_slip", rng.randint(1, 9)) for k in range(4000)], "doc_id bigint, lang string, source string, tokens bigint")
    targets = spark.createDataFrame([("bill_note", 0.5, 1), ("toll_slip", 0.4, 2), ("none", 0.1, 3)], "source string, target_share double, max_repeat int")
    drawn = mixing.mix(docs, targets)[0].toPandas()
    share = drawn.groupby("source").tokens.sum() / drawn.tokens.sum()
    assert drawn.groupby(["doc_id", "epoch"]).size().max() == 1 and drawn.groupby("doc_id").epoch.nunique().max() <= 2
    assert 0.5 <= share["bill_note"] <= 0.62 and 0.38 <= share["toll_slip"] <= 0.5
    again = mixing.mix(docs, targets)[0].toPandas()
    assert set(map(tuple, drawn.values)) == set(map(tuple, again.values))


def test_the_smallest_source_does_not_set_the_size(spark):
    from tests.conftest import DATA

    shares = mixing.p9_shares(spark, DATA).toPandas()
    # each leaf ends with a whole document
    assert shares.drawn_tokens.sum() == pytest.approx(shares.source_tokens.sum(), rel=0.1)
    assert mixing.p9_shares_even(spark, DATA).groupBy().sum("drawn_tokens").first()[0] < 0.5 * shares.drawn_tokens.sum()
    short = shares[(shares.target_share > 0) & (shares.source_tokens > 0) & (shares.target_share * shares.source_tokens.sum() > 1.01 * shares.source_tokens * shares.max_repeat)]
    assert len(short) and short.drawn_tokens.tolist() == (short.source_tokens * short.max_repeat).tolist()
    assert mixing.p9_mix(spark, DATA).groupBy().sum("tokens").first()[0] == shares.drawn_tokens.sum()


# ---------------------------------------------------------------- languages


def test_labels():
    assert [languages.named(x) for x in ("zh-CN", "ZHO", "de_DE", "English", "und", "", None, "xx")] == ["zh", "zh", "de", "en", None, None, None, None]
    words = languages.codewords()
    assert min((words[i] != words[j]).sum() for i in range(9) for j in range(i)) >= 5


def test_held_out_accuracy_and_mixed_lines(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts, labels = languages.training_sample(docs)
    order = np.random.RandomState(1).permutation(len(texts))
    fit, held = order[: len(order) * 2 // 3], order[len(order) * 2 // 3 :]
    codes = languages.fit([texts[i] for i in fit], [labels[i] for i in fit])
    got, _ = codes.decode(codes.margins([texts[i] for i in held])[0])
    assert np.mean([languages.LANGUAGES[g] == labels[i] for g, i in zip(got, held)]) >= 0.9
    text = "The hotel stay came to 70.84 and the receipt is attached below.\n\n123.45\n按照最新的住宿标准，每晚超出部分由个人承担。 Please check whether the tickets belong to the same trip."
    found, lines = languages.assign(pa.array([text, "", None, "12.5\n---"]), codes)
    assert found[0][0] == 0 and found[0][3] and [(n, lang) for _, n, lang, *_ in lines] == [(0, "en"), (3, "zh+en")] and len(found) == 1


def test_wrong_labels_do_not_outvote_a_common_language(spark):
    zh = [f"{x}补助按天计算，市内交通{y}报销。" for x in ("伙食", "住宿") for y in ("实额", "包干")]
    own = {"en": "The receipt for the taxi is attached below.", "fr": "Le reçu du taxi se trouve en annexe.", "ko": "택시 영수증은 아래에 첨부되어 있습니다."}
    forms = {"en": ["en", "eng", "english"], "fr": ["fr", "fra", "fre", "french"], "ko": ["ko", "kor", "korean"]}
    rows = [(text, "zh") for text in zh for _ in range(200)]
    for lang, names in forms.items():  # each of these labels has a few documents of the common language
        rows += [(text, form) for form in names for text, n in [(own[lang], 20), *[(x, 5) for x in zh]] for _ in range(n)]
    docs = spark.createDataFrame([(k, *row) for k, row in enumerate(rows)], "doc_id bigint, text string, lang string")
    few, languages.SAMPLE_DOCS = languages.SAMPLE_DOCS, 440
    try:
        texts, labels = languages.training_sample(docs)
    finally:
        languages.SAMPLE_DOCS = few
    assert dict(zip(texts, labels)) == {x: "zh" for x in zh} | {own[k]: k for k in own}


# ---------------------------------------------------------------- linkage


def test_cores():
    alike = linkage.cores_alike
    assert alike("壶盅蕙", "壶盅蕙") == 1 and alike("榴藤萱", "藤萱") == 0.8 and alike("帚盅橘", "帚盅榴") == 0.7 and alike("萝梨茉", "萝橘茉") == 0.7 and alike("haltaldusi", "haltadusi") == 0.9
    assert alike("haltaldusi", "haltaldu") == 0.95 and alike("壶盅蕙", "菱葵襟") == 0 and alike("", "a") == 0 and alike("壶盅蕙", "abc") == 0


def test_one_to_one(spark):
    rows = [(1, 10, 0, 0, 1.0, 1.0), (1, 11, 0, 0, 1.0, 1.0), (2, 10, 5, 0, 1.0, 1.0), (2, 12, 0, 3, 0.7, 0.5), (3, 12, 1, 0, 0.7, 0.5)]
    pairs = spark.createDataFrame(rows, "inv bigint, pay bigint, diff bigint, gap int, alike double, cosine double")
    assert sorted((r["inv"], r["pay"]) for r in linkage.one_to_one(pairs).collect()) == [(1, 10), (2, 12)]


def test_signatures_keep_like_cores_together():
    rng = random.Random(1)
    cores = {"".join(rng.choice("梨桑绫岑垣蓼藤桐停纱粟椰柘萱荻") for _ in range(3)): 5 for _ in range(300)} | {"壶盅蕙": 9, "壶盅榴": 1, "菱葵襟": 9, "琴杏芷": 9, "haltaldusi": 5, "haltadusi": 2}
    v, df = linkage.train(cores, [("壶盅蕙", "haltaldusi")] * 20, 1)
    m = linkage.Vectors(v, df)
    x = {c: m.of(c) for c in cores}
    assert x["壶盅蕙"] @ x["壶盅蕙"] > 0.99 and x["壶盅蕙"] @ x["壶盅榴"] > x["壶盅蕙"] @ x["菱葵襟"] and x["haltaldusi"] @ x["haltadusi"] > 0.3
    met = lambda a, b: bool(set(m.keys(a)) & set(m.keys(b)))
    assert met("壶盅蕙", "壶盅榴") and met("壶盅蕙", "壶梨蕙") and met("盅蕙", "壶盅蕙") and met("haltaldusi", "haltadusi") and not met("壶盅蕙", "菱葵襟")


def test_lost_names():
    lost = linkage.lost_alike
    assert lost("柏薯砖店".encode("gb18030").decode("utf-8", "replace"), "柏薯砖") and not lost("柏薯砖店".encode("gb18030").decode("utf-8", "replace"), "黍箕麦黍箕")
    assert lost("榛嶇畷楹?", "黍箕麦") and not lost("榛嶇畷楹?", "云月出") and lost("锟斤拷锟斤拷锟斤拷锟斤拷", "薯椿") and not lost("锟斤拷", "薯椿萝椰") and not lost("?", "abcd")


def test_calibration_compares_with_chance():
    cell = lambda shadow, alike, n: {"shadow": shadow, "alike": alike, "tenths": 5, "off": 0, "n": n}
    w = linkage.fit([cell(False, 1.0, 900), cell(True, 1.0, 2), cell(False, 0.3, 100), cell(True, 0.3, 10)], 9.0)
    share = lambda alike: 1 - np.exp(-(w[0] + w[1] * 0.5 + w[2] * alike))
    assert share(1.0) > 0.95 and share(0.3) < 0.5 and (linkage.fit([], 1.0) == 0).all()


def test_candidates_meet_once(spark):
    cols = "seq bigint, nh bigint, keys array<bigint>, cents bigint, day int"
    rng = random.Random(4)
    rows = [(k, rng.randint(0, 5), [1, 2, rng.randint(3, 5)], rng.randint(0, 900), rng.randint(0, 40)) for k in range(200)]
    inv, pay = rows[:80], rows[80:]
    got = sorted((r["inv"], r["pay"]) for r in linkage.candidates(spark.createDataFrame(inv, cols), spark.createDataFrame(pay, cols)).collect())
    assert got == sorted((i[0], p[0]) for i in inv for p in pay if abs(i[3] - p[3]) <= 100 and 0 <= i[4] - p[4] <= 7)


def test_broadcasts_are_bounded_by_bytes(spark):
    hinted = lambda df, n: "strategy=broadcast" in linkage.small(df, n)._jdf.queryExecution().analyzed().toString()
    wide = spark.createDataFrame([], "nh bigint, core string, vec binary, keys array<bigint>")
    assert not hinted(wide, 400_000) and hinted(wide, 50_000) and hinted(wide.select("nh"), 200_000) and not hinted(wide.select("nh"), 400_000)


def test_one_matrix_goes_to_the_driver(spark, monkeypatch):
    rng = random.Random(3)
    cores = spark.createDataFrame([(k, "".join(rng.choice("梨桑绫岑垣蓼藤桐停纱粟椰柘萱荻") for _ in range(3))) for k in range(60)], "nh bigint, core string")
    links = spark.createDataFrame([], "core string, other string")
    kind, sent = type(cores), []
    collect = kind.collect
    monkeypatch.setattr(kind, "collect", lambda df: sent.append(collect(df)) or sent[-1])
    monkeypatch.setattr(linkage, "PART_NAMES", 10)
    got = []
    for merged in (16, 2):
        monkeypatch.setattr(linkage, "MERGED", merged)
        sent.clear()
        vectors = linkage.core_vectors(cores, links, 60)
        assert [len(x) for x in sent] == [1]
        got.append(sorted((r["nh"], r["core"], r["keys"]) for r in vectors.collect()))
    assert len(got[0]) == 60 and got[0] == got[1]
    sent.clear()
    assert linkage.core_vectors(cores.limit(0), links, 0).count() == 0 and sent == [[]]
