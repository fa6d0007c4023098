"""Text normalisation, tokenising and splitting as JVM-side column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: conjunctions that part a proposition; names of languages
CONJUNCTIONS = ("and", "but", "however", "although", "while")
ANSWER_CONJUNCTIONS = ("and", "but", "however")
# fixed values: blanks of any script (Unicode's space separators); Spark's trim alone takes U+0020 only
BLANKS = " \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"
LANGUAGE_CODES = {"english": "en", "spanish": "es", "french": "fr", "german": "de", "italian": "it", "portuguese": "pt", "dutch": "nl", "russian": "ru", "chinese": "zh", "japanese": "ja", "korean": "ko", "arabic": "ar"}


def letters_lower(text: Column) -> Column:
    """Lower case letter by letter; Spark's ``lower`` makes two characters of U+0130 and looks at the neighbours of a sigma."""
    return F.lower(F.replace(F.replace(text, F.lit("\u0130"), F.lit("i")), F.lit("\u03a3"), F.lit("\u03c3")))


def collapse(text: Column) -> Column:
    """White space runs become one blank; ends are trimmed."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def normalize(text: Column) -> Column:
    """Lower case without control characters, white space collapsed."""
    kept = F.regexp_replace(F.lower(text), r"[\x00-\x08\x0B-\x1F]", "")
    return collapse(kept)


def words(text: Column) -> Column:
    """Words between white space; no word for an empty text, unlike ``split``."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != "")


def word_count(text: Column) -> Column:
    """Number of words between white space, counted without building them."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"\S+"))


def regex_word_count(text: Column) -> Column:
    """Words as runs of letters, digits and underscores of any script."""
    return F.regexp_count(text, F.lit(r"[\p{L}\p{N}_]+"))


def whole_word(pattern: str) -> str:
    """``pattern`` between ASCII word boundaries, on any Java version; Java 17's ``\\b`` takes other letters for word signs too."""
    return rf"(?<![A-Za-z0-9_])(?:{pattern})(?![A-Za-z0-9_])"


def ngrams(text: Column, n: int = 3) -> Column:
    """Word n-grams of the normalised text; the whole text if it has fewer words.

    The word list is bound by a lambda of its own: an expression that an inner lambda holds is evaluated for each of
    that lambda's elements, so the text would be split again for every n-gram.
    """

    def grams(w: Column) -> Column:
        each = F.transform(F.sequence(F.lit(1), F.size(w) - (n - 1)), lambda i: F.array_join(F.slice(w, i, n), " "))
        return F.when(F.size(w) == 0, F.array().cast("array<string>")).when(F.size(w) < n, F.array(F.array_join(w, " "))).otherwise(each)

    return F.transform(F.array(words(normalize(text))), grams)[0]


def word_overlap(a: Column, b: Column) -> Column:
    """Jaccard similarity of two texts' word sets; 0 if both are empty."""
    x, y = F.array_distinct(words(normalize(a))), F.array_distinct(words(normalize(b)))
    union = F.size(F.array_union(x, y))
    return F.when(union == 0, 0.0).otherwise(F.size(F.array_intersect(x, y)) / union)


def has_control(text: Column) -> Column:
    return text.rlike(r"[\x00-\x08\x0B\x0C\x0E-\x1F]")


def strip_citations(text: Column) -> Column:
    """Without ``[n]`` marks, white space collapsed."""
    return collapse(F.regexp_replace(text, r"\[\d+\]", ""))


def sentences(text: Column, min_words: int = 1) -> Column:
    """Runs up to and with their closing marks, trimmed: the sentence rule of this library."""
    found = F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"([^.!?]+[.!?]*)")), lambda s: collapse(s))
    return F.filter(found, lambda s: (s != "") & (word_count(s) >= min_words))


def truncate_at_sentence(text: Column, limit: int) -> Column:
    """Whole sentences while their text stays within ``limit`` characters; the cut text if not even one fits."""
    fits = F.aggregate(
        sentences(text),
        F.struct(F.lit("").alias("t"), F.lit(False).alias("full")),
        lambda a, s: F.struct(
            F.when(a["full"] | (F.length(a["t"]) + F.length(s) + 1 > limit), a["t"]).otherwise(F.concat(a["t"], F.when(a["t"] == "", "").otherwise(" "), s)).alias("t"),
            (a["full"] | (F.length(a["t"]) + F.length(s) + 1 > limit)).alias("full"),
        ),
        lambda a: a["t"],
    )
    return F.when(F.length(text) <= limit, text).when(fits == "", F.substring(text, 1, limit)).otherwise(fits)


def is_heading(text: Column) -> Column:
    """Short, begins upper-case, no closing mark, and over 30 % upper-case characters."""
    return (F.length(text) < 100) & text.rlike(r"^\p{Lu}") & ~text.rlike(r"[.!?,]$") & (F.length(F.regexp_replace(text, r"[^\p{Lu}]", "")) / F.length(text) > 0.3)


def is_list_item(text: Column) -> Column:
    return F.trim(text).rlike(r"^([-*•+]|\d+[.)\]])\s")


def propositions(text: Column, min_words: int = 5, max_words: int = 40) -> Column:
    """Sentences; those beyond ``max_words`` are parted at conjunctions, and parts are cut to ``max_words``."""
    pattern = r"\s+(?:" + "|".join(CONJUNCTIONS) + r")\s+"
    cut = lambda s: F.array_join(F.slice(words(s), 1, max_words), " ")
    parts = F.flatten(F.transform(sentences(text), lambda s: F.when(word_count(s) <= max_words, F.array(s)).otherwise(F.transform(F.split(s, "(?i)" + pattern), cut))))
    return F.filter(parts, lambda p: word_count(p) >= min_words)


def answer_propositions(answer: Column, limit: int = 5) -> Column:
    """Claims of an answer: sentences under 5 words join the one before, long ones are parted; the first ``limit``."""
    pieces = F.split(F.trim(F.coalesce(answer, F.lit(""))), r"(?<=[.!?])\s+")
    pattern = r"(?i)\s+(?:" + "|".join(ANSWER_CONJUNCTIONS) + r")\s+"

    def step(acc: Column, s: Column) -> Column:
        n = word_count(s)
        last = F.size(acc)
        merged = F.concat(F.slice(acc, 1, F.greatest(last - 1, F.lit(0))), F.array(F.concat_ws(" ", F.try_element_at(acc, F.lit(-1)), s)))
        return F.when((n < 5) & (last > 0), merged).when(n > 40, F.concat(acc, F.split(s, pattern))).otherwise(F.concat(acc, F.array(s)))

    folded = F.aggregate(pieces, F.array().cast("array<string>"), step)
    return F.filter(F.transform(F.slice(folded, 1, limit), lambda x: F.trim(x)), lambda p: p != "")


def query_terms(query: Column) -> Column:
    """Distinct lower-case terms of two characters or more, in order."""
    return F.filter(F.array_distinct(F.split(F.trim(F.regexp_replace(F.lower(query), r"[^\p{L}\p{N}_\s]", " ")), r"\s+")), lambda t: F.length(t) > 1)


def tokens(text: Column) -> Column:
    """Lower-case words of letters, digits and underscores."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"([\p{L}\p{N}_]+)"))


def padded(low: Column) -> Column:
    """Words of a lower-case text with two blanks between and around them, so that ``' w '`` finds and counts whole words."""
    return F.concat(F.lit("  "), F.regexp_replace(F.coalesce(low, F.lit("")), r"[^\p{L}\p{N}_]+", "  "), F.lit("  "))


def word_mark(word: Column) -> Column:
    """The form in which :func:`padded` texts hold a word."""
    return F.concat(F.lit(" "), word, F.lit(" "))


def occurrences(text: Column, term: Column) -> Column:
    """Non-overlapping occurrences of ``term`` as a substring."""
    return F.when(F.length(term) == 0, 0).otherwise(((F.length(text) - F.length(F.replace(text, term))) / F.length(term)).cast("int"))


def sanitize_query(query: Column, limit: int = 1000) -> Column:
    return F.substring(F.trim(F.regexp_replace(query, r"[\x00-\x08\x0B-\x1F]", "")), 1, limit)


def boolean_query(query: Column) -> Column:
    """Terms joined by AND, without NUL and double quotes."""
    return F.array_join(words(F.regexp_replace(F.trim(query), "[\\x00\"]", "")), " & ")


def snippet_around(text: Column, terms: Column, limit: int = 300) -> Column:
    """-100/+200 characters around the first hit, terms marked, white space collapsed."""
    low = F.lower(text)
    hits = F.filter(F.transform(terms, lambda t: F.position(t, low)), lambda p: p > 0)
    at = F.array_min(hits)
    start = F.greatest(at - 100, F.lit(1))
    window = F.when(at.isNull(), F.substring(text, 1, limit)).otherwise(F.substr(text, start, F.least(at + 200, F.length(text) + 1) - start))
    marked = F.aggregate(terms, window, lambda acc, t: F.regexp_replace(acc, F.concat(F.lit(r"(?i)\Q"), t, F.lit(r"\E")), F.concat(F.lit("**"), t, F.lit("**"))))
    body = F.concat(F.when(at.isNotNull() & (start > 1), "...").otherwise(""), marked, F.when(at.isNotNull() & (at + 200 <= F.length(text)), "...").otherwise(""))
    flat = collapse(body)
    return F.when(F.length(flat) > limit, F.concat(F.substring(flat, 1, limit), F.lit("..."))).otherwise(flat)


def snippet_plain(text: Column, limit: int = 300) -> Column:
    flat = collapse(text)
    return F.when(F.length(flat) > limit, F.concat(F.substring(flat, 1, limit), F.lit("..."))).otherwise(F.concat(F.lit("..."), flat, F.lit("...")))


def clean_snippet(snippet: Column, limit: int = 300) -> Column:
    flat = collapse(F.replace(F.replace(snippet, F.lit("<b>"), F.lit("**")), F.lit("</b>"), F.lit("**")))
    return F.when(F.length(flat) > limit, F.concat(F.substring(flat, 1, limit), F.lit("..."))).otherwise(flat)


def content_hash(text: Column) -> Column:
    """SHA-256 of the lower-cased text with collapsed white space."""
    return F.sha2(F.lower(collapse(text)), 256)


def normalize_path(path: Column) -> Column:
    """Identifiers in a request path become ``{id}``."""
    uuid = r"(?i)/[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}"
    return F.regexp_replace(F.regexp_replace(path, uuid, "/{id}"), r"/\d+", "/{id}")


def clean_text(text: Column) -> Column:
    return F.nullif(collapse(F.regexp_replace(text, r"[\x00\r]", " ")), F.lit(""))


def clean_keywords(keywords: Column, limit: int = 50) -> Column:
    return F.slice(F.filter(F.transform(keywords, lambda x: F.trim(x)), lambda k: (k != "") & (F.length(k) <= 100)), 1, limit)


def language_code(language: Column) -> Column:
    """Two-letter code of a language name, code or locale."""
    low = F.lower(F.trim(language))
    names = F.create_map(*(F.lit(x) for pair in LANGUAGE_CODES.items() for x in pair))
    return F.coalesce(F.try_element_at(names, low), F.when(F.length(low) == 2, low), F.when(low.rlike(r"^[a-z]{2}[-_]"), F.substring(low, 1, 2)))


def token_count(text: Column) -> Column:
    """The default token count: a quarter of the characters, rounded up."""
    return F.ceil(F.length(text) / 4).cast("int")


def truncate_tokens(text: Column, limit: int) -> Column:
    return F.substring(text, 1, 4 * limit)


def rag_prompt(question: Column, contexts: Column, instruction: str = "Answer from the context only.") -> Column:
    numbered = F.array_join(F.transform(contexts, lambda c, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), c)), "\n\n")
    return F.concat(F.lit(instruction + "\n\nContext:\n"), numbered, F.lit("\n\nQuestion: "), question, F.lit("\nAnswer:"))


def llm_cost(tokens_in: Column, tokens_out: Column, per_million_in: float, per_million_out: float) -> Column:
    return tokens_in * per_million_in / 1e6 + tokens_out * per_million_out / 1e6


def cache_key(query: Column, document_ids: Column, top_k: Column, *flags: Column) -> Column:
    return F.sha2(F.concat_ws(":", query, F.array_join(F.array_sort(document_ids), ","), top_k.cast("string"), *(f.cast("string") for f in flags)), 256)


def set_key(texts: Column) -> Column:
    """The same key for any order of the texts."""
    return F.sha2(F.array_join(F.array_sort(texts), "|"), 256)


def variations(response: Column, limit: int) -> Column:
    """Query variations from a numbered or dashed list."""
    lines = F.filter(F.transform(F.split(response, "\n"), lambda x: F.trim(x)), lambda s: s.rlike(r"^[\d-]"))
    bare = F.transform(lines, lambda s: F.trim(F.regexp_replace(s, r"^(\d+[.)]|-)\s*", "")))
    return F.slice(F.filter(bare, lambda s: F.length(s) > 3), 1, limit)


def html_escape(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def answer_prompt(question: Column, passages: Column) -> Column:
    """Question under numbered passages with their source, page and section; ``passages``: array of (name, page, section, text)."""
    head = lambda p: F.concat_ws(", ", F.coalesce(p["name"], F.lit("Unknown")), F.when(p["page"].isNotNull(), F.concat(F.lit("Page "), p["page"].cast("string"))), F.nullif(p["section"], F.lit("")))
    parts = F.transform(passages, lambda p, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] ("), head(p), F.lit(")\n"), p["text"]))
    return F.concat(F.lit("Answer with [n] marks from these sources only.\n\n"), F.array_join(parts, "\n\n"), F.lit("\n\nQuestion: "), question, F.lit("\nAnswer:"))


def truncate_tokens_at_sentence(text: Column, limit: Column | int) -> Column:
    """Whole sentences while their tokens stay within ``limit``; null if none fits."""
    limit = limit if isinstance(limit, Column) else F.lit(limit)

    def step(a: Column, s: Column) -> Column:
        n = token_count(s)
        full = a["full"] | (a["n"] + n > limit)
        return F.struct(F.when(full, a["t"]).otherwise(F.concat(a["t"], F.when(a["t"] == "", "").otherwise(" "), s)).alias("t"), F.when(full, a["n"]).otherwise(a["n"] + n).cast("int").alias("n"), full.alias("full"))

    return F.aggregate(sentences(text), F.struct(F.lit("").alias("t"), F.lit(0).alias("n"), F.lit(False).alias("full")), step, lambda a: F.nullif(a["t"], F.lit("")))
