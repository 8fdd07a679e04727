"""Concepts of the films: 25 of them, over a vocabulary that also holds rare words."""

import pytest

from tessera.plans import texts


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("films"))
    plots = [[] for _ in range(40)]
    for j in range(1200):  # each of these words stands in two films, the words of lsa_query in one
        word = "q" + "".join(chr(97 + j // 26**k % 26) for k in range(3)) + "o"
        plots[j % 40].append(word)
        plots[(j + 1 + j % 38) % 40].append(word)
    plots[0] += ["fortress", "station", "coin"]
    spark.createDataFrame([(k, " ".join(p)) for k, p in enumerate(plots)], "film_id long, plot string").coalesce(1).write.parquet(f"{d}/films.parquet")
    return d


def test_25_concepts(spark, folder):
    assert {r["concept"] for r in texts.lsa_topics(spark, folder).collect()} == set(range(25))
    assert {r["concept"] for r in texts.lsa_documents(spark, folder).collect()} == set(range(25))


def test_rare_words_of_a_query_count(spark, folder):
    assert texts.lsa_query(spark, folder).count() == 25
