import random

from runweave.llm import quality

S = [
    "The night shift checked the run history and found that the box had not completed before the deadline.",
    "Nobody could say why the job was left on ice, but it was restarted without a ticket in the morning.",
    "As soon as the file has landed, the batch reads the export and writes its output to the archive.",
    "We would rather split the box than raise the limit once more, and that is what the owners asked for.",
]


def documents():
    rnd = random.Random(6)
    prose = [" ".join(rnd.choice(S) for _ in range(rnd.randrange(2, 6))) for _ in range(300)]
    prose += ["\n".join(" ".join(rnd.sample(S, 3)).split(" ")[i : i + 9].__str__().strip("[]").replace("'", "").replace(",", "") for i in range(0, 45, 9)) for _ in range(20)]
    other = ["\n".join(f"- check host{rnd.randrange(99)}" for _ in range(12)), "\n".join(f"| job_{i} | SU | {i * 7} |" for i in range(15)), "retry now\n" * 30]
    other += ["\n".join(f"2025-01-{i:02d} 10:00:00,123 WARN agent.q - t={i * 977}us" for i in range(1, 20)), "aGVsbG8gd29ybGQ" * 40, "insert_job: a_b_c job_type: CMD\nowner: x\nn_retrys: 1\n" * 5]
    other += [" ".join(rnd.choice("mon tue wed ledger fees eur purge claims load jan".split()) for _ in range(80))]
    rows = [(i, t, "en", 1.0) for i, t in enumerate(prose)] + [(1000 + i, t, rnd.choice(["en", None]), 1.0) for i, t in enumerate(other)]
    return rows + [(2000, None, "en", 1.0), (2001, "", None, 1.0), (2002, " \n\t ", "en", 1.0)], {1000 + i for i in range(len(other))}


def test_tails_are_not_prose(spark):
    rows, want = documents()
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, chars double")
    got = {r["doc_id"] for r in quality.not_prose(df, "doc_id", "text", "lang").collect()}
    assert got == want
    assert quality.not_prose(df.limit(0), "doc_id", "text", "lang").count() == 0


def test_statistics_and_percentiles(spark):
    rows, _ = documents()
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, chars double")
    out = {r["doc_id"]: r for r in quality.statistics(df, "doc_id", "text", "lang").collect()}
    assert out.keys() == {r[0] for r in rows if r[1] is not None}
    assert out[2001]["n_words"] == 0 and out[2001]["mean_word_length"] == 0
    words = sorted(out[k]["n_words"] for k in range(300))
    assert out[max(range(300), key=lambda k: out[k]["n_words"])]["n_words_percentile"] >= 90
    assert words[0] == min(words)
    assert quality.statistics(df.limit(0), "doc_id", "text", "lang").count() == 0


def test_common_words_are_learned_from_sentences_of_every_language(spark):
    rows = [(i, "foo bar, baz unique%s.\nthis line doesn't end" % chr(97 + i), "xx") for i in range(20)] + [(50, "The end.", "en"), (51, None, "xx"), (52, "no sentence", "yy"), (53, "nobody's.", None)]
    rows += [(60, "再試行します。", "ja")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r["lang"]: set(r["words"]) for r in quality.common_words(df, "text", "lang", 0.02).collect()}
    assert got == {"xx": {"foo", "bar", "baz"}, "en": {"the", "end"}, "ja": set("再試行します")}


def test_language_of_a_text_without_one_or_in_another():
    m = quality.Measure({"en": frozenset("the of and is".split()), "pl": frozenset("i w z na".split())})
    assert m.language("the end of it and".split(), "*") == ("en", 0.6)
    assert m.language("i w na".split(), "en") == ("pl", 1.0)
    assert m.language("q x i z v t".split(), "pl") == ("pl", 2 / 6)
    assert m.language([], "en") == ("en", None) and quality.Measure({}).language(["a"], "en") == ("en", None)


def test_long_texts_without_any_sentence(spark):
    """Word salads of every length, without punctuation or line ends, and stanzas of definitions in a corpus of which a third is no prose."""
    rnd = random.Random(4)
    rows = [(i, " ".join(rnd.choice(S) for _ in range(rnd.randrange(2, 6))), "en") for i in range(200)]
    words = "mon tue wed ledger fees eur purge claims load jan crm aml hr nav stage of the".split()
    other = [" ".join(rnd.choice(words) for _ in range(n)) for n in (25, 60, 100, 1000)]
    other += ["\n\n".join(f"insert_job: aa_b_{i}   job_type: CMD\nowner: svc_x\ncommand: /opt/batch/x.sh\nn_retrys: {i % 4}" for i in range(n)) for n in range(1, 90)]
    other += ["".join(rnd.choice("acdefjklqswxz  ") for _ in range(900)) for _ in range(7)]
    rows += [(1000 + i, t, "en") for i, t in enumerate(other)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert {r["doc_id"] for r in quality.not_prose(df, "doc_id", "text", "lang").collect()} == {1000 + i for i in range(len(other))}


LINES = {
    "en": ["Please wait while the page is loading again.", "The connection to the archive was lost and will be opened once more in a minute."],
    "de": ["Bitte warten Sie, die Seite wird geladen.", "Die Verbindung zum Archiv ist unterbrochen und wird in einer Minute noch einmal aufgebaut, bitte haben Sie etwas Geduld mit uns."],
    "fr": ["Veuillez patienter pendant que la page se charge.", "La connexion avec le serveur est perdue et sera ouverte encore une fois dans une minute."],
    "es": ["Espere por favor mientras se carga la página.", "La conexión con el servidor se ha perdido y se abrirá otra vez dentro de un minuto."],
    "pl": ["Proszę czekać, strona jest teraz ładowana od nowa.", "Połączenie z archiwum zostało przerwane i za minutę będzie otwarte jeszcze raz dla wszystkich."],
    "ja": ["接続が切れました、再試行しています", "アーカイブへの接続が失われたため、一分後にもう一度だけ接続を試みますのでお待ちください。"],
}


def test_a_line_over_and_over_is_not_prose(spark):
    rnd = random.Random(8)
    rows, want, k = [(i, " ".join(rnd.sample(S, 3)), "en") for i in range(400)], set(), 1000
    for lang, lines in LINES.items():
        rows += [(k + i, " ".join(rnd.sample(lines * 2, 3)), lang) for i in range(5)]
        for line in lines:
            for sep in ("\n", "\n\n", "\r\n \r\n", " "):
                for n in (8, 200):
                    k += 10
                    want.add(k)
                    rows.append((k, sep.join([line] * n), lang))
            # every second line another one; and half of the text at most
            k += 10
            want.add(k)
            rows.append((k, "\n".join(f"{line}\nx{i}" for i in range(9)), lang))
        k += 10
    rows.append((1, " ".join(S) + "\n\n" + "Please wait while the page is loading again.\n" * 8, "en"))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert {r["doc_id"] for r in quality.not_prose(df, "doc_id", "text", "lang").collect()} == want
    parts = [S[0], "a b\nc", " ".join([S[1]] * 5)]
    assert quality.repeated_shares(parts, [quality._WORD.findall(p.lower()) for p in parts]) == [0.0] * 3


def test_more_rows_of_a_language_lose_no_document(spark):
    rnd = random.Random(5)
    prose = {"en": S, "ja": [x + "。" for x in ("夜間バッチは予定より遅れて終了しました", "この設定は来月見直す予定です", "依存関係を確認してから再実行してください")]}
    rows = [(i, " ".join(rnd.sample(S, 3)), "en") for i in range(400)]
    bad = [LINES["ja"][0] + "\n", "まだ、"]
    rows += [(1000, bad[0] * 60, "ja"), (1001, bad[0] * 60, None), (1002, bad[1] * 7 + "おわりました、" + bad[1] * 7, "ja")]
    found = []
    # many Japanese blocks, of which 12 have many phrases
    for n in (0, 190, 210, 600):
        more = [(2000 + i, "\n\n".join(rnd.sample(prose["ja"], 2)), "ja") for i in range(n // 2)]
        more += [(5000 + i, "確認、" * 15 + "".join(prose["ja"]), "ja") for i in range(12 if n else 0)]
        df = spark.createDataFrame(rows + more, "doc_id long, text string, lang string")
        found.append({r["doc_id"] for r in quality.not_prose(df, "doc_id", "text", "lang").collect()} & {r[0] for r in rows})
    assert {1000, 1001, 1002} <= found[0] and all(a <= b for a, b in zip(found, found[1:], strict=False))


def test_scores_are_those_of_the_language_however_few(spark):
    rows = [(i, "one two three four five", "en") for i in range(300)] + [(1000 + i, " ".join(["raz"] * n), "pl") for i, n in enumerate((50, 60, 70))] + [(2000, "a b", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    out = {r["doc_id"]: r for r in quality.statistics(df, "doc_id", "text", "lang").collect()}
    assert len(out) == len(rows) and out[1001]["n_words_z"] == 0 and out[1000]["n_words_z"] < 0 < out[1002]["n_words_z"]
    assert out[1000]["n_words_percentile"] < out[1001]["n_words_percentile"] < out[1002]["n_words_percentile"]
    assert out[2000]["n_words_z"] < 0
