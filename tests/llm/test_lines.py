from __future__ import annotations

import duckdb

from corpusflow.llm import lines


def reports(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    return [r for r in lines.report(df).orderBy("doc_id").collect()]


def test_rules(spark):
    cases = {
        "A sentence ends.": "", 'He said "yes."': "", "Really?": "", "no end": "punctuation", "A*** b### c.": "punctuation", "WOW!! NOW!!": "punctuation", "One two three four five six!!": "",
        "Home | About | Contact | Login": "navigation", "home, about us, contact.": "navigation", "Next": "navigation", "He went home.": "", "All rights reserved.": "boilerplate", "Copyright 2020 us.": "boilerplate",
        "Released under the MIT License.": "boilerplate", "A | b.": "",
    }
    for r, (text, why) in zip(reports(spark, list(cases)), cases.items()):
        found = next((x for x in lines.REASONS if r[f"removed_{x}"]), "")
        assert found == why, text


def test_rules_of_other_languages(spark):
    cases = {
        "Alle Rechte vorbehalten.": "boilerplate", "Unsere Datenschutzerklärung gilt hier.": "boilerplate", "Startseite | Über uns | Kontakt": "navigation", "Weiterlesen": "navigation",
        "Die Rechte der Völker bleiben vorbehalten.": "", "Tous droits réservés.": "boilerplate", "Ce site utilise des cookies.": "boilerplate", "Accueil / À propos / Aide": "navigation", "Il se connecte au réseau.": "",
        "Todos los derechos reservados.": "boilerplate", "Haga clic aquí.": "boilerplate", "Inicio > Noticias > Más": "navigation", "Los derechos son de todos.": "",
        "これは文です。": "", "هل هذا نص؟": "", "यह एक वाक्य है।": "", "これは文": "punctuation", "A publicación bajo el sol.": "", "Relicensed under water.": "",
    }
    for r, (text, why) in zip(reports(spark, list(cases)), cases.items()):
        found = next((x for x in lines.REASONS if r[f"removed_{x}"]), "")
        assert found == why, text


def test_documents(spark):
    good, bad = "This is a good sentence of prose.", "no end here"
    rows = reports(spark, [f"{good}\n{bad}\n\n {good} ", f"{bad}\n{bad}\n{bad}\n{bad}\n{good}", good, bad])
    assert rows[0]["cleaned"] == f"{good}\n{good}" and rows[0]["keep"] and rows[0]["n_lines"] == 3
    assert [r["keep"] for r in rows] == [True, False, True, False]
    assert (rows[0]["chars_before"], rows[0]["chars_after"]) == (2 * len(good) + len(bad), 2 * len(good))


def test_clean_keeps_columns(spark, odd):
    kept = lines.clean(odd)
    assert kept.columns == odd.columns
    rows = {r["doc_id"]: r for r in kept.collect()}
    assert rows[1]["text"] and all(r["n_chars"] == len(r["text"]) for r in rows.values())
    assert set(rows) == {1, 2, None, 6, 7, 9}


def test_odd_rows(odd, empty):
    rows = lines.report(odd).collect()
    assert len(rows) == 13
    by = {r["doc_id"]: r for r in rows}
    assert by[5]["cleaned"] is None and not by[5]["keep"] and by[3]["cleaned"] == "" and not by[3]["keep"] and not by[4]["keep"]
    assert by[7]["keep"] and by[7]["chars_after"] > 300_000
    assert lines.report(empty).count() == 0 and lines.clean(empty).count() == 0


def test_sql_agrees_on_odd_rows(odd):
    columns = ["doc_id", "n_lines", *[f"removed_{r}" for r in lines.REASONS], "chars_before", "chars_after", "cleaned", "keep"]
    documents = odd.select("doc_id", "text").toPandas()  # noqa: F841
    con = duckdb.connect()
    con.register("documents", documents)
    want = con.sql(f"select {', '.join(columns)} from ({lines.SQL})").fetchall()
    key = lambda r: repr([str(x) for x in r])
    clean = lambda r: [None if x is None or x != x else (int(x) if c == "doc_id" else x) for c, x in zip(columns, r)]
    assert sorted(key(clean(r)) for r in want) == sorted(key(clean(list(r))) for r in lines.report(odd).select(*columns).collect())
