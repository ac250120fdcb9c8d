from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from plantweave.llm.reading import features, fit, fit_labels, is_prose, pool_adjacent, reading_level, tokenise

EASY = "Der Wind ist stark. Das Rad dreht sich. Wir haben Strom. Oma kocht und das Licht ist an. Ein Hund sitzt am Tor. Alle warten auf die Sonne. "
HARD = "Unbeschadet der Verpflichtungen nach Absatz 8 hat der Verpflichtete die zur Ermittlung des finanziellen Ausgleichs erforderlichen Abrechnungsgrundlagen unverzüglich in nachprüfbarer Form zu übermitteln, soweit nicht überwiegende schutzwürdige Interessen Dritter entgegenstehen. "


def test_prose():
    assert is_prose(EASY) and is_prose(HARD) and is_prose("[123-ABC] " + HARD)
    assert not is_prose(None) and not is_prose("") and not is_prose("Zu kurz für eine Stufe.")
    assert not is_prose("10:07;ORK;Börse;318,4;+23 MW\n" * 30)
    assert not is_prose('{"anlage": "WP Nord", "mw": 3.5, "tags": ["A_1", "B_2"]}\n' * 20)
    assert not is_prose("    if mw[3] >= 5:  # Nord\n        sperre('WP Nord')\n" * 20)
    assert not is_prose("1\t22\t333\n" * 40) and not is_prose("⚡ ok 電力 MW ± " * 20)
    assert is_prose("Für alle k mit x_k > 0 gilt ∑ a_k · x_k ≤ b, also d = 12. Bei U < 0,9 p. u. gibt der Regler ein Q nach der Kurve vor. " * 2)


def test_long_pieces_are_searched_whole():
    assert not is_prose(HARD + " ".join(["x" * 300 + ";a;b"] * 6))
    assert is_prose(HARD + " ".join(["x" * 100_000] * 6))


def test_batches_read_like_single_texts():
    texts = [EASY, HARD, None, "", EASY + HARD, "x", HARD * 3]
    ranker = fit([EASY, HARD, EASY * 2, HARD * 2] * 3, [1, 5, 1, 5] * 3)
    together, alone = ranker.read(texts), np.array([ranker.read([t])[0] for t in texts])
    assert np.allclose(together, alone, equal_nan=True) and np.isnan(together[[2, 3, 5]]).all()
    # Words, pairs of words with the last before the first, and ends of words, each by the root of its number.
    x = features(["ab cd ab"], tokenise(["ab cd ab"]))
    assert abs((x.value**2).sum() - 1) < 1e-9 and sorted(np.round(x.value**2 * 9).astype(int)) == [1, 1, 1, 1, 1, 2, 2]


def test_other_languages_have_no_level():
    rng = np.random.default_rng(1)
    german, english = (EASY + HARD).split(), "the wind is strong and the plant has to be shut down because the grid cannot take more power than the lines of this region are built for, which must be paid by all customers".split()
    texts = [" ".join(rng.permutation(w * 3)[:60]) for w in [german, english] * 20]
    ranker = fit(texts, [1, 5] * 20)
    french = "Le parc éolien produit de l'électricité pour la région et les habitants sont très contents de cette nouvelle installation qui remplace la vieille centrale à charbon fermée depuis deux ans."
    polish = "Elektrownia wiatrowa produkuje prąd dla całego regionu, a mieszkańcy są bardzo zadowoleni z nowej instalacji, która zastąpiła starą elektrownię węglową zamkniętą dwa lata temu przez zarząd spółki."
    assert np.isnan(ranker.read([french, polish])).all() and not np.isnan(ranker.read(texts)).any()


def test_isotonic():
    x, y = pool_adjacent(np.array([1.0, 2.0, 3.0, 4.0]), np.array([1.0, 3.0, 2.0, 4.0]))
    assert list(y) == [1.0, 1.0, 2.5, 2.5, 4.0, 4.0] and list(x) == [1.0, 1.0, 2.0, 3.0, 4.0, 4.0]


def test_levels_held_out(spark):
    rng = np.random.default_rng(0)

    def shuffled(text, n):
        s = text.strip().split(". ")
        return " ".join(str(x) for x in rng.permutation(s * n))

    texts = [shuffled(EASY, 2) for _ in range(30)] + [shuffled(HARD, 2) for _ in range(30)]
    docs = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)] + [(100, None, 0), (101, "", 0), (102, EASY * 3000, 0)], "doc_id long, text string, reading_level long")
    labels = spark.createDataFrame([(i, 1 if i < 30 else 5, "x") for i in range(60) if i % 3] + [(100, 2, "x"), (999, 3, "x"), (1, None, "x")], "doc_id long, reading_level long, text string")
    ranker = fit_labels(docs, labels)
    got = {r.doc_id: r.l for r in docs.select("doc_id", reading_level(F.col("text"), ranker).alias("l")).collect()}
    assert all(got[i] < 2.5 for i in range(30)) and all(got[i] > 3.5 for i in range(30, 60))
    assert got[100] is None and got[101] is None and got[102] < 2.5
    none = fit_labels(docs, labels.limit(0))
    assert docs.select(reading_level(F.col("text"), none).alias("l")).filter("l IS NOT NULL").count() == 0
    assert fit([EASY], [1]).level(0.0) == 1.0
