"""Quality rules, line first: rules judge lines, failing lines go, then documents that lost too much text are rejected.

Three kinds of rules: punctuation (symbols, shouting, fragments that no sign ends), navigation (separators, links,
bullets) and boilerplate (phrases of consent, licences and calls to act). Only built-in expressions: a document is
judged within its own row, nothing is shuffled, and each line is looked at once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD_GAP_CHARS

SYMBOLS = "#*$%&|<>"
#: Phrases, in lower case, of lines that sites repeat: legal notices, licences, consent, and calls to act.
BOILERPLATE = (
    "all rights reserved", "terms of use", "terms of service", "terms and conditions", "privacy policy", "cookie policy", "copyright ©", "licensed under the", "released under the", "is licensed under", "permission is hereby granted",
    "without warranty of any kind", "we use cookies", "uses cookies to", "accept all cookies", "enable javascript", "javascript is disabled", "your browser does not support", "sign in to", "log in to continue", "create an account",
    "subscribe to our", "sign up for our", "follow us on", "share this article", "click here to", "read more about", "skip to content", "back to top", "powered by wordpress", "contact us at", "unsubscribe at any time",
    "tous droits réservés", "politique de confidentialité", "conditions d'utilisation", "utilise des cookies", "alle rechte vorbehalten", "datenschutzerklärung", "verwendet cookies", "todos los derechos reservados", "política de privacidad", "utiliza cookies",
)
#: Signs that end a sentence, a quotation or a part of one.
ENDS = ".!?…:;,\"'”’»)]。！？"
SEPARATORS = "|»›•·>"
BULLETS = "•-*›»·"
#: A line with fewer blanks is a fragment unless a sign ends it; one with fewer blanks behind a bullet is an entry.
FRAGMENT_WORDS, ENTRY_WORDS, PHRASE_CHARS = 8, 4, 200
PUNCTUATION, NAVIGATION, PHRASE = 1, 2, 3
MIN_WORDS = 50


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(text, WORD_GAP_CHARS, " " * len(WORD_GAP_CHARS)), " "), "")


def _count(x: str, signs: str) -> str:
    quoted = signs.replace("'", "''")
    return f"(length({x}) - length(translate({x}, '{quoted}', '')))"


def _rules(l: str, trim: str, last: str, phrase: str) -> str:
    """SQL, in either engine, for the kind of rule that line l fails, else 0. Words are counted by blanks.

    The first of them counts: navigation: three separators or more, and one for each four words or more; two links or
    more, and one for each three words or more; or a bullet before fewer than ENTRY_WORDS words. punctuation: over a tenth of the characters are symbols; five ! or ? or more, and one for each four words or more;
    or, last, a fragment: fewer than FRAGMENT_WORDS words, and no sign of ENDS at the end. boilerplate: a phrase in a
    line under PHRASE_CHARS characters. Blank lines fail none.
    """
    n_words = f"({_count(l, ' ')} + 1)"
    links = f"((length({l}) - length(replace({l}, '://', ''))) / 3)"
    ends = ENDS.replace("'", "''")
    bullets = BULLETS.replace("'", "''")
    return (
        f"case when {trim} = '' then 0"
        f" when ({_count(l, SEPARATORS)} >= 3 and {_count(l, SEPARATORS)} * 4 >= {n_words}) or ({links} >= 2 and {links} * 3 >= {n_words}) or (instr('{bullets}', left({trim}, 1)) > 0 and {_count(trim, ' ')} < {ENTRY_WORDS}) then {NAVIGATION}"
        f" when {_count(l, SYMBOLS)} * 10 > length({l}) or ({_count(l, '!?')} >= 5 and {_count(l, '!?')} * 4 >= {n_words}) then {PUNCTUATION}"
        f" when length({l}) < {PHRASE_CHARS} and {phrase} then {PHRASE}"
        f" when {n_words} < {FRAGMENT_WORDS} and instr('{ends}', {last}) = 0 then {PUNCTUATION} else 0 end"
    )


_PHRASES = "|".join(BOILERPLATE).replace("'", "''")
#: The kind of rule that line l fails, for each engine.
LINE_RULES = _rules("l", "btrim(l, ' \t\r')", "right(btrim(l, ' \t\r'), 1)", "lower(l) rlike '" + "|".join(BOILERPLATE).replace("'", "\\'") + "'")
LINE_RULES = LINE_RULES.replace(ENDS.replace("'", "''"), ENDS.replace("'", "\\'"))


def judge_quality(docs: DataFrame, text: str = "text", max_loss: float = 0.5) -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long), base_failed, n_punctuation,
    n_navigation, n_boilerplate (lines that fail each kind of rule, long), chars, chars_lost (long), cleaned (the text
    without failing lines; null text: null) and kept (boolean). Columns of docs with these names are replaced.

    Null and empty texts have no words: they fail and aren't kept. Windows of three words are told apart by 64-bit
    hashes in their own text. Repeated rows are judged alike; an empty table gives an empty result. Columns
    starting with `__q_` are in use while it runs.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    df = docs.withColumn("__q_words", words(t)).withColumn("__q_lines", F.split(t, "\n"))
    spaced = F.translate(t, WORD_GAP_CHARS, "")
    df = df.withColumn("n_words", F.size("__q_words").cast("long")).withColumn("word_chars", F.length(spaced).cast("long"))
    df = df.withColumn("n_symbols", (F.length(spaced) - F.length(F.translate(spaced, SYMBOLS, ""))).cast("long"))
    worded = F.filter("__q_lines", lambda x: F.translate(x, WORD_GAP_CHARS, "") != "")
    df = df.withColumn("__q_worded", worded)
    df = df.withColumn("n_dup_lines", (F.size("__q_worded") - F.size(F.array_distinct("__q_worded"))).cast("long"))

    # Hashes of windows; only texts with a hash twice sort them with their places, and neighbours tell the repeats.
    df = df.withColumn("__q_windows", F.expr("if(n_words < 3, cast(array() as array<bigint>), transform(sequence(0, cast(n_words as int) - 3), i -> xxhash64(__q_words[i], __q_words[i + 1], __q_words[i + 2])))"))
    df = df.withColumn("__q_twice", F.size(F.array_distinct("__q_windows")) < F.size("__q_windows"))
    df = df.withColumn("__q_sorted", F.expr("if(__q_twice, sort_array(transform(__q_windows, (h, i) -> struct(h, i))), cast(null as array<struct<h:bigint,i:int>>))"))
    df = df.withColumn("__q_sorted_n", F.size("__q_sorted"))
    repeated = "filter(transform(__q_sorted, (x, k) -> if(x.h = try_element_at(__q_sorted, k + 2).h or (k > 0 and x.h = try_element_at(__q_sorted, if(k = 0, 1, k)).h), x.i, null)), i -> i is not null)"
    df = df.withColumn("__q_at", F.expr(f"if(__q_sorted_n > 0, {repeated}, cast(array() as array<int>))"))
    df = df.withColumn("n_repeat_words", F.expr("size(array_distinct(flatten(array(__q_at, transform(__q_at, i -> i + 1), transform(__q_at, i -> i + 2)))))").cast("long"))
    df = df.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50))

    df = df.withColumn("__q_fails", F.expr(f"transform(__q_lines, l -> {LINE_RULES})"))
    for name, kind in (("n_punctuation", PUNCTUATION), ("n_navigation", NAVIGATION), ("n_boilerplate", PHRASE)):
        df = df.withColumn(name, (F.size("__q_fails") - F.size(F.array_remove("__q_fails", kind))).cast("long"))
    df = df.withColumn("__q_good", F.expr("if(array_max(__q_fails) = 0, __q_lines, filter(__q_lines, (l, i) -> __q_fails[i] = 0))"))
    df = df.withColumn("cleaned", F.when(F.col(text).isNotNull(), F.array_join("__q_good", "\n")))
    df = df.withColumn("chars", F.length(t).cast("long"))
    df = df.withColumn("chars_lost", F.col("chars") - F.coalesce(F.length("cleaned"), F.lit(0)))
    df = df.withColumn("kept", ~F.col("base_failed") & (F.col("chars_lost") <= F.col("chars") * F.lit(max_loss)))
    return df.drop(*[c for c in df.columns if c.startswith("__q_")])


def query(spark, sf_dir: str) -> DataFrame:
    """All of documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return judge_quality(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_punctuation", "n_navigation", "n_boilerplate", "chars_lost")


_GAP = r"[\x20\x09-\x0D]"
_FAIL = _rules("l", "trim(l, ' ' || chr(9) || chr(13))", "right(trim(l, ' ' || chr(9) || chr(13)), 1)", f"regexp_matches(lower(l), '{_PHRASES}')")
SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, list_filter(regexp_split_to_array(coalesce(text, ''), '{_GAP}+'), lambda w: w <> '') AS w FROM documents),
pos AS (SELECT doc_id, unnest(range(1, greatest(len(w) - 1, 1))) AS i, w FROM d WHERE len(w) >= 3),
tri AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i + 1], w[i + 2]) AS n FROM pos),
rep AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM tri WHERE n >= 2) GROUP BY 1),
ls0 AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM d),
ls AS (SELECT doc_id, l, {_FAIL} AS fails FROM ls0),
dup AS (SELECT doc_id, count(*) FILTER (regexp_matches(l, '[^\\x20\\x09-\\x0D]')) - count(DISTINCT l) FILTER (regexp_matches(l, '[^\\x20\\x09-\\x0D]')) AS n_dup_lines,
   count(*) FILTER (fails = {PUNCTUATION}) AS n_punctuation, count(*) FILTER (fails = {NAVIGATION}) AS n_navigation, count(*) FILTER (fails = {PHRASE}) AS n_boilerplate,
   coalesce(sum(length(l)) FILTER (fails = 0), 0) + greatest(count(*) FILTER (fails = 0) - 1, 0) AS left_chars FROM ls GROUP BY 1),
m AS (SELECT d.doc_id, len(w) AS n_words, length(regexp_replace(t, '{_GAP}', '', 'g')) AS word_chars,
   length(t) - length(translate(t, '#*$%&|<>', '')) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines,
   coalesce(n_repeat_words, 0) AS n_repeat_words, length(t) AS chars, length(t) - coalesce(left_chars, 0) AS chars_lost, n_punctuation, n_navigation, n_boilerplate
   FROM d LEFT JOIN rep USING (doc_id) LEFT JOIN dup USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
   (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
   NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND chars_lost <= chars * 0.5 AS kept,
   n_punctuation, n_navigation, n_boilerplate, CAST(chars_lost AS BIGINT) AS chars_lost
FROM m
"""
