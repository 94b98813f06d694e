"""Line-first cleaning.

Every line is judged by itself; the first rule that it fails names the reason.

- ``boilerplate``: it holds a stock phrase of one of four languages (licenses, rights, cookies, scripts, policies,
  placeholder text);
- ``navigation``: three or more separators as in menus and breadcrumbs, or nothing but menu words of these languages;
- ``punctuation``: it doesn't end as a sentence does, or marks follow at least a fifth of its words in runs
  (``###``, ``%%%``, ``!!``).

Failed lines are removed; a document that keeps less than ``LEAST_KEPT`` of the characters of its lines is rejected.

Cases. Blank lines are dropped and count for nothing. Null text has 0 lines and null ``cleaned``, and is rejected; so are
empty and blank texts, whose ``cleaned`` is empty. A null ``doc_id`` stays null. Repeated rows are each judged. Lines of
any length are judged whole. An empty table gives an empty result. Other columns are not read; ``clean`` returns them
untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEAST_KEPT = 0.5
SEPARATORS = 3
MARKED = 0.2

#: English, German, French and Spanish; further languages are further rows.
_phrases = {
    "en": [
        "all rights reserved", "licensed under", "released under the", "public license", "terms of (use|service)", "terms and conditions", "privacy policy", "use cookies", "cookie policy",
        "enable javascript", "javascript is (disabled|required)", "lorem ipsum", "subscribe to our newsletter", "copyright (\\(c\\)|©|[0-9]{4})", "click here to", "powered by wordpress",
    ],
    "de": [
        "alle rechte vorbehalten", "lizenziert unter", "veröffentlicht unter der", "nutzungsbedingungen", "allgemeine geschäftsbedingungen", "datenschutzerklärung", "datenschutzhinweise", "(verwendet|verwenden) cookies",
        "cookie-(richtlinie|einstellungen)", "javascript (aktivieren|ist deaktiviert)", "(unseren newsletter|newsletter abonnieren)", "klicken sie hier", "hier klicken",
    ],
    "fr": [
        "tous droits réservés", "sous licence", "publié sous", "conditions (générales )?d['’]utilisation", "politique de confidentialité", "mentions légales", "(utilise|utilisons) des cookies", "politique (relative aux|de) cookies",
        "activer javascript", "javascript est désactivé", "abonnez-vous à notre", "inscrivez-vous à notre", "cliquez ici",
    ],
    "es": [
        "todos los derechos reservados", "bajo (la )?licencia", "publicado bajo", "términos (de uso|y condiciones)", "condiciones de uso", "política de privacidad", "aviso legal", "(utiliza|utilizamos|usa|usamos) cookies", "política de cookies",
        "(habilite|habilitar|active) javascript", "javascript está desactivado", "(suscríbete|suscríbase) a nuestr[oa]", "(haga|haz) clic aquí",
    ],
}
_menus = {
    "en": "home|about|about us|contact|contact us|login|log in|sign in|sign up|register|search|menu|next|previous|prev|back|top|share|print|faq|help|sitemap|news|blog|shop|cart|more|read more",
    "de": "startseite|über uns|kontakt|anmelden|abmelden|registrieren|suche|suchen|menü|weiter|zurück|vor|nach oben|teilen|drucken|hilfe|inhaltsverzeichnis|nachrichten|warenkorb|mehr|mehr lesen|weiterlesen|impressum|datenschutz",
    "fr": "accueil|à propos|contactez-nous|connexion|se connecter|s['’]inscrire|recherche|rechercher|suivant|précédent|retour|haut de page|partager|imprimer|aide|plan du site|actualités|boutique|panier|plus|lire la suite|en savoir plus",
    "es": "inicio|sobre nosotros|quiénes somos|contacto|iniciar sesión|registrarse|buscar|búsqueda|menú|siguiente|anterior|volver|arriba|compartir|imprimir|ayuda|mapa del sitio|noticias|tienda|carrito|más|leer más|seguir leyendo",
}
_menu = "|".join(_menus.values())
# phrases start words, which also spares most places the trial of all of them
BOILERPLATE = "(^|[^a-zà-ÿ])(" + "|".join(p for ps in _phrases.values() for p in ps) + ")"
MENU = f"^({_menu})([ /,;:>|·•»›-]+({_menu}))*[.!]?$"
SEPARATOR = "( [|·•»›>] )"
ENDING = "[.!?…。！？؟۔।][\"'”’»)\\]」』]*$"
MARKS = "([#$%&*=~^_+<>@]{3,}|!{2,}|[?]{3,})"
REASONS = ("boilerplate", "navigation", "punctuation")


def _trim(line: Column) -> Column:
    return F.regexp_replace(line, "^[ \\t\\r\\f]+|[ \\t\\r\\f]+$", "")


def reason(line: Column) -> Column:
    """The rule that a trimmed line fails, or ''."""
    count = lambda pattern: F.size(F.regexp_extract_all(line, F.lit(pattern), F.lit(0)))
    low = F.lower(line)
    return (
        F.when(low.rlike(BOILERPLATE), "boilerplate")
        .when((count(SEPARATOR) >= SEPARATORS) | low.rlike(MENU), "navigation")
        .when(~line.rlike(ENDING) | (count(MARKS) >= MARKED * count("[^ \\t]+")), "punctuation")
        .otherwise("")
    )


def judged(text: Column) -> Column:
    """The non-blank lines of a text, trimmed, each with its reason."""
    lines = F.filter(F.transform(F.split(text, "\n"), _trim), lambda x: x != "")
    return F.transform(lines, lambda x: F.struct(x.alias("line"), reason(x).alias("reason")))


def _kept(lines: Column) -> Column:
    return F.filter(lines, lambda x: x["reason"] == "")


def _chars(lines: Column) -> Column:
    return F.aggregate(lines, F.lit(0).cast("bigint"), lambda n, x: n + F.length(x["line"]))


def _count(lines: Column, why: str) -> Column:
    return F.size(F.filter(lines, lambda x: x["reason"] == why)).cast("bigint")


def report(docs: DataFrame, least_kept: float = LEAST_KEPT) -> DataFrame:
    """For every row: doc_id, n_lines, lines removed by each rule, n_chars before and after, cleaned text, keep."""
    # the array of judged lines feeds every other column: a generator in between keeps it from being computed for each
    rows = docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), docs["text"].cast("string").alias("text"))
    rows = rows.select("doc_id", F.explode(F.array(F.coalesce(judged(F.col("text")), F.array().cast("array<struct<line:string,reason:string>>")))).alias("l"), F.col("text").isNull().alias("none"))
    removed = [_count(F.col("l"), r).alias(f"removed_{r}") for r in REASONS]
    rows = rows.select("doc_id", F.size("l").cast("bigint").alias("n_lines"), *removed, _chars(F.col("l")).alias("chars_before"), _chars(_kept(F.col("l"))).alias("chars_after"),
                       F.when(~F.col("none"), F.array_join(F.transform(_kept(F.col("l")), lambda x: x["line"]), "\n")).alias("cleaned"))
    return rows.withColumn("keep", (F.col("chars_after") > 0) & (F.col("chars_after") >= F.lit(least_kept) * F.col("chars_before")))


def clean(docs: DataFrame, least_kept: float = LEAST_KEPT) -> DataFrame:
    """The rows of ``docs`` that stay, with their cleaned text (and, where the table has it, its ``n_chars``)."""
    lines = docs.select("*", F.explode(F.array(judged(docs["text"].cast("string")))).alias("_cf_lines"))
    before, after = _chars(F.col("_cf_lines")), _chars(_kept(F.col("_cf_lines")))
    kept = lines.where((after > 0) & (after >= F.lit(least_kept) * before))
    kept = kept.withColumn("text", F.array_join(F.transform(_kept(F.col("_cf_lines")), lambda x: x["line"]), "\n")).drop("_cf_lines")
    return kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else kept


def _q(pattern: str) -> str:
    return pattern.replace("'", "''")


SQL = f"""
WITH lines AS (
  SELECT doc_id, text, list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^[ \\t\\r\\f]+|[ \\t\\r\\f]+$', '', 'g')), lambda x: x <> '') AS l
  FROM documents
), judged AS (
  SELECT doc_id, text, coalesce(list_transform(l, lambda x: {{'line': x, 'reason': CASE
      WHEN regexp_matches(lower(x), '{_q(BOILERPLATE)}') THEN 'boilerplate'
      WHEN len(regexp_extract_all(x, '{_q(SEPARATOR)}')) >= {SEPARATORS} OR regexp_matches(lower(x), '{_q(MENU)}') THEN 'navigation'
      WHEN NOT regexp_matches(x, '{_q(ENDING)}') OR len(regexp_extract_all(x, '{_q(MARKS)}')) >= {MARKED} * len(regexp_extract_all(x, '[^ \\t]+')) THEN 'punctuation'
      ELSE '' END}}), []) AS l
  FROM lines
), counted AS (
  SELECT doc_id, len(l)::BIGINT AS n_lines,
    {", ".join(f"len(list_filter(l, lambda x: x.reason = '{r}'))::BIGINT AS removed_{r}" for r in REASONS)},
    coalesce(list_sum(list_transform(l, lambda x: length(x.line))), 0)::BIGINT AS chars_before,
    coalesce(list_sum(list_transform(list_filter(l, lambda x: x.reason = ''), lambda x: length(x.line))), 0)::BIGINT AS chars_after,
    CASE WHEN text IS NOT NULL THEN coalesce(array_to_string(list_transform(list_filter(l, lambda x: x.reason = ''), lambda x: x.line), chr(10)), '') END AS cleaned
  FROM judged
)
SELECT *, chars_after > 0 AND chars_after >= {LEAST_KEPT} * chars_before AS keep FROM counted
"""
