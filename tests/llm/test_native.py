import re
import zlib

from cases import awkward_documents, corpus, empty_documents, rows_of
from pyspark.sql import functions as F

from contrastry.llm import feistel, linequality, sharding, urlfilter

WORD = re.compile(r"[^\x20\x09-\x0D]+")


# ------------------------------------------------------------------ addresses
def test_url_rules(spark):
    urls = ["http://Example.NET/en/x", "http://a.example.net/de/", "https://example.com/de/1?x", "http://notexample.com/de/", "x.org/fr/", None, "", "http://b.org/fr/é#/de/",
            "http://net", "ftp://net/", "http://a.net?/x", "http://u://net/x"] * 2
    df = spark.createDataFrame([(i, u, "clash", "x", "y") for i, u in enumerate(urls)], "page_id long, url string, host string, verdict string, address string")
    got = {i: (h, p, r, v) for i, h, p, r, v in rows_of(urlfilter.apply_rules(df, urlfilter.rule_table(spark)).select("page_id", "host", "path", "rule", "verdict"))}
    assert len(got) == len(urls)
    want = [("example.net", "/en/x", "example.net/en/", "allow"), ("a.example.net", "/de/", "net/", "block"), ("example.com", "/de/1", "example.com/de/", "block"),
            ("notexample.com", "/de/", None, "allow"), ("", "", None, "allow"), ("", "", None, "allow"), ("", "", None, "allow"), ("b.org", "/fr/é", "org/fr/", "allow"),
            ("net", "", None, "allow"), ("net", "/", "net/", "block"), ("a.net", "", None, "allow"), ("u:", "//net/x", None, "allow")]
    assert [got[i] for i in range(len(urls))] == want * 2


def test_url_rules_with_same_place_and_without_rules(spark):
    df = spark.createDataFrame([(1, "http://a.b/c")], "page_id long, url string")
    both = urlfilter.rule_table(spark, (("b", "/c", "allow"), ("b", "/c", "block"), ("b", "", "allow")))
    assert urlfilter.apply_rules(df, both).first()["verdict"] == "block"
    assert urlfilter.apply_rules(df, both.limit(0)).first()["verdict"] == "allow"
    assert urlfilter.apply_rules(df.limit(0), both).count() == 0


# ------------------------------------------------------------------ quality
def repeated(words):
    seen, hit = {}, set()
    for i in range(len(words) - 2):
        seen.setdefault(tuple(words[i:i + 3]), []).append(i)
    for places in seen.values():
        if len(places) > 1:
            hit.update(p + k for p in places for k in range(3))
    return len(hit)


def test_base_measures_match_brute_force(spark):
    docs = corpus(3, 80) + [(500, "a b a b a b a"), (501, "x x x x"), (502, "one\n\none\n \none two")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r[0]: r[1:] for r in rows_of(linequality.judge(df).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"))}
    for d, text in docs:
        words = WORD.findall(text)
        lines = [line for line in text.split("\n") if WORD.search(line)]
        rep = repeated(words)
        assert got[d] == (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), rep, len(words) < 50 or 100 * rep > 50 * len(words)), d


def test_line_rules(spark):
    good = "This line says something, and says it well. " * 4
    texts = [good * 4, "\n".join([good] * 2 + ["home | about | contact | help | login"] * 9 + ["%d words of prose follow, plainly." % i for i in range(30)]),
             "\n".join([good, "Home | News | Sport | More | Shop | Jobs | Travel | Maps " * 20, "All rights reserved."]), "\n".join([good] * 3 + [f"Heading {i}" for i in range(3)])]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {r["doc_id"]: r for r in linequality.judge(df).collect()}
    assert not rows[2]["kept"] and "|" not in rows[2]["cleaned"] and "rights" not in rows[2]["cleaned"]
    assert "|" not in rows[1]["cleaned"] and "Heading" not in rows[3]["cleaned"] and rows[3]["cleaned"].startswith(good)


def test_clean_markdown_code_and_other_scripts_stay(spark):
    clean = ["The design in question was good.", "Our catalog in print, and the blog in short.", "They spread more news.", "Use **bold** text here, please.", "**Note:** see **this**.",
             "if (a == b && c == d) { return 1; }", "self.__init__(x, y)", "यह एक साफ वाक्य है।", "これは文です。", "هل هذا نص؟"]
    fail = ["Please sign in.", "Read more.", "THIS!! IS!! ALL!! LOUD.", "AUF,!! UND!! AB.", "Heading", "!!!!!!!! ???? now."]
    rows = linequality.judge(spark.createDataFrame([(0, "\n".join(clean)), (1, "\n".join(fail)), (2, "\n".join(f"यह{i} वाक्य{i} अलग{i} है{i}।" for i in range(20)))], "doc_id long, text string")).orderBy("doc_id").collect()
    assert rows[0]["cleaned"].split("\n") == clean and rows[1]["cleaned"] == "" and rows[2]["kept"]


def test_quality_awkward_rows(spark):
    df = linequality.judge(awkward_documents(spark))
    assert {"ids", "host", "lang"} <= set(df.columns) and df.columns.count("kept") == 1
    by = {(r["doc_id"], r["n_words"]): r for r in df.collect()}
    assert by[2, 0]["base_failed"] and not by[2, 0]["kept"] and by[2, 0]["cleaned"] == "" and by[6, 60_001]["n_words"] == 60_001
    assert linequality.judge(empty_documents(spark)).count() == 0


# ------------------------------------------------------------------ pseudonyms
def luhn(number):
    digits = [int(c) for c in reversed(number)]
    return sum(d if i % 2 == 0 else 2 * d - 9 * (d > 4) for i, d in enumerate(digits)) % 10 == 0


def test_pseudonyms_keep_format_and_links(spark):
    text = "Pay 4111 1111 1111 1111 or 4111-1111-1111-1111, not 4111111111111112; born 1984-02-29, 29.02.1984 or 31.02.1984; at 10.0.0.1 or 999.1.1.1; " \
           "+1 (017) 555-7713; und.34@mail7.example.com token = \"04dbebab91ab85687d33eeaaf9ac699e1188f962\""
    docs = spark.createDataFrame([(1, text), (2, "again 4111111111111111 and 1984-02-29 und.34@mail7.example.com"), (3, "nothing here, 12 apples"), (4, None), (5, "")], "doc_id long, text string")
    out = {r["doc_id"]: r for r in feistel.pseudonymise(docs).collect()}
    one, two = out[1]["text"], out[2]["text"]
    cards = re.findall(r"\d{4}[ -]\d{4}[ -]\d{4}[ -]\d{4}", one)
    plain = {re.sub(r"\D", "", c) for c in cards}
    assert len(cards) == 2 and len(plain) == 1 and luhn(plain.copy().pop()) and plain.copy().pop() in two and "4111111111111111" not in two
    assert "4111111111111112" in one and "31.02.1984" in one and "999.1.1.1" in one and "10.0.0.1 " not in one
    date = re.search(r"born (\d{4})-(\d{2})-(\d{2}), (\d{2})\.(\d{2})\.(\d{4})", one)
    assert date.group(1, 2, 3) == date.group(6, 5, 4) and date.group(1) + "-" + date.group(2) + "-" + date.group(3) in two
    assert "555-7713" not in one and re.search(r"\+1 \(\d{3}\) \d{3}-\d{4}", one)
    mail = re.search(r"[a-z]{3}\.\d\d@mail7\.example\.com", one).group()
    assert mail in two and mail != "und.34@mail7.example.com"
    assert re.search(r'token = "[0-9a-f]{40}"', one) and "04dbebab" not in one
    assert out[3]["text"] == "nothing here, 12 apples" and out[4]["text"] is None and out[5]["text"] == ""
    assert out[1]["n_pseudonyms"] == [1, 1, 1, 1, 2, 2]


def test_cards_beside_other_numbers(spark):
    near = ["4111 1111 1111 1111 12/27", "4111111111111111 123", "card 2 4111 1111 1111 1111", "4111 1111 1111 1111 5500-0000-0000-0004 7", "12 34 4111-1111-1111-1111 56 78",
            "4111 1111 1111 1111 29.02.1984", "4111 1111 1111 1111 10.0.0.1", "4111111111111112 5", "1" * 25, "77 4111111111111111 42@mail.example.com"]
    rows = feistel.pseudonymise(spark.createDataFrame(list(enumerate(near)), "doc_id long, text string")).orderBy("doc_id").collect()
    got, counts = [r["text"] for r in rows], [r["n_pseudonyms"] for r in rows]
    assert [c[5] for c in counts] == [1, 1, 1, 2, 1, 1, 1, 0, 0, 1] and got[7:9] == near[7:9]
    assert all("4111 1111" not in g and "4111-1111" not in g and "4111111111111111" not in g for g in got)
    moved = {re.sub(r"\D", "", g) for g in (re.search(r"\d{4}[ -]?\d{4}[ -]?\d{4}[ -]?\d{4}", g).group() for i, g in enumerate(got) if i not in (4, 7, 8))}
    assert len(moved) == 1 and luhn(moved.copy().pop())
    assert got[0].endswith(" 12/27") and got[1].endswith(" 123") and got[2].startswith("card 2 ") and got[3].endswith(" 7") and "0000-0000" not in got[3]
    assert counts[5][4] == 1 and "29.02" not in got[5] and counts[6][2] == 1 and "10.0.0.1" not in got[6] and counts[9][0] == 1 and " 42@" not in got[9]


def test_phone_numbers_and_dates_in_other_layouts(spark):
    phones = ["+44 20 7946 0958", "+33 1 23 45 67 89", "+49 30 12345678", "+442079460958", "(555) 123-4567", "555-123-4567", "1-800-555-0187", "+1 (555) 123-4567", "020 7946 0958", "+44 (0)20 7946 0958"]
    dates = ["5.3.1990", "1984/02/29", "12/25/2020", "25/12/2020", "2020-12-25", "05.03.1990", "29-02-1984"]
    stay = ["31.02.1984", "13/32/2020", "1.2.3", "+12 34", "123-456", "2020/01/12/x"]
    both = ["4111 1111 1111 1111 555-123-4567", "+49 30 12345 4111 1111 1111 1111", "+33 1 23 45 67 89 12 x", "4111 1111 1111 1111 12/25/2020"]
    texts = [f"see {t}, then" for t in phones + dates + stay + both]
    rows = feistel.pseudonymise(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    got, counts = [r["text"][4:-6] for r in rows], [r["n_pseudonyms"] for r in rows]
    n, m, k = len(phones), len(phones) + len(dates), len(phones) + len(dates) + len(stay)
    assert all(c == [0, 0, 0, 1, 0, 0] for c in counts[:n]) and all(g != p and re.sub(r"\d", "0", g) == re.sub(r"\d", "0", p) for g, p in zip(got, phones))
    digits = [re.sub(r"\D", "", g) for g in got]
    assert digits[4] == digits[5] == digits[7][1:] and digits[0][2:] == digits[3][2:] == digits[8][1:] == digits[9][3:] and digits[0][:2] == "44" and got[6][:2] == "1-"
    assert all(c == [0, 0, 0, 0, 1, 0] for c in counts[n:m])
    a, b = [re.split(r"\D", g) for g in got[n:m]], got[n:m]
    assert b[0] != "5.3.1990" and a[0] == [str(int(x)) for x in a[5]] and a[1] == a[6][::-1] and b[1][4] == "/" and b[6][2] == "-"
    assert a[3][::-1] == a[4] and [a[2][2], a[2][0], a[2][1]] == a[4] and int(a[2][1]) > 12
    assert got[m:k] == stay and not any(sum(c) for c in counts[m:k])
    assert [c[3:] for c in counts[k:]] == [[1, 0, 1], [1, 0, 1], [1, 0, 0], [0, 1, 1]] and all("4111 1" not in g and "1111 1111" not in g for g in got[k:])
    assert got[k].endswith(got[5]) and got[k + 2] == got[1] + " 12 x" and got[k + 3].endswith(got[n + 2])


def test_permutations_are_bijections(spark):
    numbers = spark.range(1000).select(F.lpad(F.col("id").cast("string"), 3, "0").alias("v"))
    assert numbers.select(feistel.permute_text(F.col("v"), feistel.DIGITS, "k", "x").alias("p")).distinct().count() == 1000
    days = spark.range(0, 146_097, 37).select(F.date_format(F.date_from_unix_date((F.col("id") + feistel.CYCLE_START).cast("int")), "yyyy-MM-dd").alias("v"))
    moved = days.select(feistel.pseudonym_date(F.col("v"), "k").alias("p"))
    assert moved.distinct().count() == days.count() and moved.where("p < '1700-01-01' or p > '2099-12-31' or p is null").count() == 0
    other = numbers.select(feistel.permute_text(F.col("v"), feistel.DIGITS, "other key", "x").alias("p"), "v").where("p = v").count()
    assert other < 20


def test_pseudonyms_awkward_rows(spark):
    docs = awkward_documents(spark)
    out = feistel.pseudonymise(docs)
    assert out.columns == [*docs.columns, "n_pseudonyms"] and out.count() == docs.count()
    assert out.where("doc_id = 6").first()["text"] == docs.where("doc_id = 6").first()["text"]
    assert feistel.pseudonymise(empty_documents(spark)).count() == 0


# ------------------------------------------------------------------ shards
def test_layout_is_balanced_and_gapless(spark):
    docs = [(i, "x" * (i * i % 997)) for i in range(3000)] + [(None, None), (5, "x"), (5, "x"), (7, "é")]
    records = sharding.slotted(spark.createDataFrame(docs, "doc_id long, text string"), 512)
    loads = sharding.slot_loads(records)
    measured = {r["virtual_slot"]: r["bytes"] for r in loads.collect()}
    path = sharding.scratch_path(spark, "map")
    before = sharding.first_map(512, 8)
    after = sharding.rebalanced(before, measured, 8)
    sharding.write_map(spark, path, 0, before)
    sharding.write_map(spark, path, 1, after)
    assert [r["shard"] for r in sharding.read_map(spark, path, 0).orderBy("virtual_slot").collect()] == before
    rows = sharding.layout(records, sharding.read_map(spark, path), loads).collect()
    assert len(rows) == len(docs) and sum(a != b for a, b in zip(before, after)) < 100
    totals = {}
    for shard in range(8):
        own = [r for r in rows if r["shard"] == shard]
        assert sorted(r["slot"] for r in own) == list(range(len(own)))
        totals[shard] = sum(r["size"] for r in own)
    assert max(totals.values()) - min(totals.values()) < 1000
    assert sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["size"], r["text_crc32"]) for r in rows) == sorted(
        (d is not None, d or 0, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in docs)


def test_growing_moves_slots_only_to_the_new_shard():
    loads = {i: 100 + i % 7 for i in range(512)}
    before = sharding.rebalanced(sharding.first_map(512, 8), loads, 8)
    after = sharding.rebalanced(before, loads, 9)
    assert all(b == 8 or b == a for a, b in zip(before, after)) and after.count(8) in range(50, 64)


def test_empty_layout(spark):
    records = sharding.slotted(empty_documents(spark), 16)
    loads = sharding.slot_loads(records)
    path = sharding.scratch_path(spark, "map")
    sharding.write_map(spark, path, 0, sharding.rebalanced(sharding.first_map(16, 8), {}, 8))
    assert rows_of(sharding.layout(records, sharding.read_map(spark, path), loads)) == []
    assert sharding.slotted(awkward_documents(spark)).count() == awkward_documents(spark).count()


def test_long_runs_of_groups_and_labels_do_not_kill_the_task(spark):
    texts = ["7341 " * 100_000, "12-" * 100_000 + "3", "a@" + "b." * 100_000 + "c", "9" * 300_000, "+49" + " 1" * 50_000, "4111 1111 1111 1111 " * 500, "1.2." * 50_000]
    rows = feistel.pseudonymise(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    assert [r["text"] == t for r, t in zip(rows, texts)][:2] == [True, True] and rows[3]["text"] == texts[3] and rows[6]["text"] == texts[6]
    assert rows[2]["text"] != texts[2] and rows[2]["text"].endswith("b.c") and rows[5]["n_pseudonyms"][5] == 500 and "4111" not in rows[5]["text"]


def test_tables_of_figures_stay_and_cards_in_usual_layouts_go(spark):
    import random

    r = random.Random(9)
    tables = [" ".join(str(r.randrange(*span)) for _ in range(300)) for span in ((10, 100), (1_000, 10_000), (1, 10**6), (100, 10**4), (1_000, 10_000), (10**5, 10**6)) for _ in range(30)]
    rows = feistel.pseudonymise(spark.createDataFrame(list(enumerate(tables)), "doc_id long, text string")).collect()
    changed = sum(a != b for row in rows for a, b in zip(tables[row["doc_id"]].split(), row["text"].split()))
    assert changed < 300 * len(tables) / 1_000
    cards = ["4111111111111111", "5555 5555 5555 4444", "3782 822463 10005", "3056-930902-5904", "4222 2222 22222", "6011111111111117", "2023 4111 1111 1111 1111", "4111 1111 1111 1111 2027",
             "4111 1111 1111 1111 123", "6200 0000 0000 0000 000", "12 4111 1111 1111 1111 5555 5555 5555 4444 4111 1111 1111 1111 9"]
    got = feistel.pseudonymise(spark.createDataFrame(list(enumerate(cards)), "doc_id long, text string")).orderBy("doc_id").collect()
    assert [g["n_pseudonyms"][5] for g in got] == [1] * 10 + [3]
    assert got[6]["text"].startswith("2023 ") and got[7]["text"].endswith(" 2027") and got[8]["text"].endswith(" 123")
    none = ["9111111111111111", "4111111111111112", "1234 5678 9012 3456", "0000 0000 0000 0000"]
    assert [g["text"] for g in feistel.pseudonymise(spark.createDataFrame(list(enumerate(none)), "doc_id long, text string")).orderBy("doc_id").collect()] == none


def test_key_of_the_session_decides(spark):
    docs = spark.createDataFrame([(1, "4111111111111111 on 1984-02-29")], "doc_id long, text string")
    one, two, again = (feistel.pseudonymise(docs, key=k).first()["text"] for k in ("a", "b", "a"))
    assert one == again != two
    assert feistel.pseudonymise(docs).first()["text"] == feistel.pseudonymise(docs).first()["text"] and len(spark.conf.get(feistel.KEY_SETTING)) == 64
