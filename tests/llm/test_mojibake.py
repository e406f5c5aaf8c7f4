import random

import pytest

from runweave.llm import mojibake

CLEAN = [
    "Prüfung der Beträge für München", "größer als 30 Tage – löschen", "Übergabe an die Spätschicht", "été comme hiver, à vérifier", "Tâche arrêtée dès réception",
    "MANUTENÇÃO DA FILA, REVISÃO À NOITE", "não repetir às três horas", "código pequeño mañana temprano", "¿Falta el fichero? Avisar a operación", "Загрузка котировок, повтор через час",
    "сверка счетов после полуночи", "только в будни 3 × 5", "入力ファイルの到着を待つ（最大三回）", "毎週水曜 夜間の残高照合", "Księgowanie opłat, źródło: główny rejestr", "σφάλμα δικτύου Αποστολή αρχείων",
    "“soft” stop ≈ 3½ units — don’t", "run 22:00–04:00 ±5 % → next ✓", "naïve café façade № 5 … later", "plain ascii only",
]
WRONG = [("utf-8", "latin-1"), ("utf-8", "cp1252"), ("utf-8", "cp437"), ("utf-8", "mac_roman"), ("cp1251", "latin-1"), ("cp1251", "koi8-r"), ("cp850", "cp1252")]


def garbled(text, to, by):
    try:
        t = text.encode(to).decode(by)
    except UnicodeError:
        return None
    return t if t != text else None


@pytest.fixture(scope="module")
def table(spark):
    rnd = random.Random(4)
    rows = []
    for i in range(1500):
        rows.append((i, 0, f"/* note {i} */\r\n# {rnd.choice(CLEAN)}; {rnd.choice(CLEAN)}\n", None))
    for i in range(1500, 1650):
        to, by = rnd.choice(WRONG)
        t = rnd.choice(CLEAN[:16])
        if (g := garbled(t, to, by)) is not None:
            rows.append((i, 1, f"owner: x\n# {g}\n", t))
    rows += [(2000, 1, "Schl�ssel", None), (2001, 0, None, None), (2002, 0, "", None), (2003, 0, "x" * 100_000, None), (2004, 0, "label \\u00e9t\\u00e9 kept", None)]
    return spark.createDataFrame(rows, "file_id long, seq int, raw_text string, chains string")


def test_held_out_garbling_is_found_and_restored(table):
    rows = {r["file_id"]: r for r in table.collect()}
    out = {r["file_id"]: r for r in mojibake.restored(table, ["file_id", "seq"], "raw_text").collect()}
    wrong = {k for k, r in rows.items() if r["seq"] == 1}
    assert len(out.keys() & wrong) >= 0.97 * len(wrong)
    assert not out.keys() - wrong
    whole = [k for k in out if k < 2000]
    right = sum(rows[k]["chains"] in out[k]["restored_text"] for k in whole)
    assert right >= 0.9 * len(whole)


def test_no_rows(table):
    assert mojibake.restored(table.limit(0), ["file_id", "seq"], "raw_text").count() == 0


def test_twice_garbled_and_lost_bytes():
    once = "größer".encode().decode("cp1252")
    twice = once.encode().decode("latin-1")
    assert any(t == once for _, t in mojibake.readings(twice))
    assert any(t == "größer" for _, t in mojibake.readings(once))


@pytest.fixture(scope="module")
def model():
    words = mojibake.Counter()
    for i in range(200):
        words.update(mojibake._TOKEN.findall(CLEAN[i % len(CLEAN)]))
    return mojibake.Model(mojibake._table(words), sum((len(w) + 1) * n for w, n in words.items()))


def test_counts_are_those_of_plain_counting(model):
    text = "größer größer als"
    words = mojibake.Counter(text.split())
    table = mojibake._table(words)
    assert table.sum() == 2 * sum(n * (len(w) + 1 + len(w) + 1 + len(w) + len(w) + 1 + len(w)) for w, n in words.items())
    chars, _ = mojibake._row(["größer"])
    a, b = mojibake._hashes(chars, 2, 3)
    assert min(table[0][a[3]], table[1][b[3]]) == 2  # "röß" ends two characters after its first


def test_texts_decoded_wrongly_many_times_are_restored(model):
    text = "Prüfung der Beträge für München"
    for deep in range(1, 7):
        text = text.encode().decode("latin-1")
        got, chains, found = model.restore(text, 3.0)
        assert found and got == "Prüfung der Beträge für München" and len(chains) >= 1, deep


def test_a_legacy_pair_and_then_utf8(model):
    once = "Загрузка котировок, повтор через час".encode("cp1251").decode("latin-1")
    assert model.restore(once.encode().decode("cp1252", "strict"), 3.0)[0] == "Загрузка котировок, повтор через час"


def test_lost_second_bytes_and_replaced_characters(model):
    assert model.restore("MANUTENÃ‡ÃƒO Ã\u00a0 NOITE, Ã  s horas".replace("\u00a0", " "), 3.0)[2]
    assert model.restore("été comme hiver, Ã  vérifier", 3.0)[0] == "été comme hiver, à vérifier"
    assert model.restore("Schl�ssel für", 3.0) == ("Schl�ssel für", [], True)
    assert not model.restore("größer – 3½ units", 3.0)[2]


def test_margin_is_chosen_on_held_out_lines():
    rows = [(0, False, 90), (2, False, 10), (4, False, 1), (1, True, 1), (12, True, 20), (30, True, 70)]
    assert 5 <= mojibake._margin(rows) <= 12
    assert mojibake._margin([]) == mojibake.MARGIN
