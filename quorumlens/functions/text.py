"""Text columns: cleaning, tokens, flags and overlaps."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .keys import canonical_role

# ---- Fixed values -----------------------------------------------------------------------------------------

TOKEN = "([a-z0-9']+)"
QUESTION_WORDS = [
    "who", "what", "when", "where", "why", "how", "do", "does", "did", "is", "are", "am", "was", "were", "can", "could",
    "would", "should", "will", "have", "has", "had", "may", "might",
]
PREDICTION_PREFIXES = [
    "Response:", "Reply:", "Assistant:", "Listener:", "Speaker:", "Generated response:", "Mistral-Sibyl Response:", "B:", "A:",
]
RESPONSE_PREFIXES = ["Response:", "Reply:", "Assistant:", "Listener:", "Speaker:", "Generated response:", "B:", "A:"]
NEXT_TURN_MARKERS = ["\nA:", "\nB:", "\nUser:", "\nAssistant:", "\nSpeaker:", "\nListener:"]
EVAL_PREFIXES = ["Rewritten reply:", "Expanded reply:", "Shortened reply:", "Reply:", "A:", "B:"]
EVAL_MARKERS = [
    "\nContext:", "\nSituation:", "\nDialogue:", "\nCandidate reply:", "\nRewritten reply:", "\nExpanded reply:",
    "\nShortened reply:", "\nInstruction:", "\nRecommended reply:", "\nShared content plan:", "\nContent plan:", "\n---",
    " Recommended reply:", " Shared content plan:", " Content plan:", " ---",
]
ROLE_MARKER = r"(^|\n)\s*(A|B|Speaker|Listener|User|Assistant)\s*:"
PUNCTUATION_EDGE = r".,!?;:'\"()\[\]{} "

GENERIC_A_EXACT = [
    "i understand", "i understand how you feel", "i'm sorry to hear that", "i am sorry to hear that",
    "that sounds really hard", "that sounds tough", "it's okay", "i'm here for you",
]
GENERIC_A_PATTERNS = [
    r"\bi understand\b", r"\bi'?m sorry\b", r"\bi am sorry\b", r"\bsorry to hear\b", r"\bthat sounds\b", r"\bi hope\b",
    r"\bit'?s okay\b", r"\bi can imagine\b", r"\bthat must be\b", r"\bi'?m here for you\b", r"\bthank you for sharing\b",
    r"\bthanks for sharing\b", r"\beverything will be okay\b",
]
GENERIC_B_EXACT = [
    "i'm sorry to hear that", "i understand how you feel", "that sounds really hard", "i'm here for you",
]
GENERIC_B_PATTERNS = [
    r"\bi'?m sorry\b", r"\bi am sorry\b", r"\bsorry to hear\b", r"\bi understand\b", r"\bi can understand\b",
    r"\bthat sounds (hard|tough|difficult|rough)\b", r"\bi'?m here for you\b", r"\bhope you feel better\b",
    r"\bi hope (you|it|everything)\b", r"\bthank you for sharing\b", r"\bthanks for sharing\b", r"\bthat'?s great\b",
    r"\bthat'?s wonderful\b",
]
GENERIC_C_PHRASES = [
    "i'm sorry", "i am sorry", "sorry to hear", "that sounds", "i understand", "i know how you feel", "that's great",
    "that's awesome", "oh no",
]
GENERIC_D_STARTS = [
    "i understand", "i'm sorry", "im sorry", "i am sorry", "that sucks", "i know how you feel", "yeah", "okay",
]
SHORT_BELOW, LONG_ABOVE = 18, 32


def any_of(conds: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, conds)


# ---- Cleaning ---------------------------------------------------------------------------------------------

def clean(c: Column) -> Column:
    """`_comma_` to comma, whitespace collapsed, no blank before a comma."""
    spaced = F.regexp_replace(F.replace(F.coalesce(c, F.lit("")), F.lit("_comma_"), F.lit(",")), r"\s+", " ")
    return F.replace(F.trim(spaced), F.lit(" ,"), F.lit(","))


def clean_context(c: Column) -> Column:
    """Chat markers removed, more than two line breaks shortened to two."""
    bare = F.regexp_replace(F.coalesce(c, F.lit("")), r"</?s>|\[/?INST\]", "")
    return F.regexp_replace(F.regexp_replace(bare, r"\n{3,}", "\n\n"), r"^\s+|\s+$", "")


def match_text(c: Column) -> Column:
    """Lower case, everything but letters, digits and apostrophes becomes one blank."""
    return F.trim(F.regexp_replace(F.lower(clean(c)), r"[^a-z0-9']+", " "))


def content_key(situation: Column, history: Column, reference: Column) -> Column:
    """Digest of situation, history texts and reference, each in match form."""
    texts = F.transform(history, lambda h: match_text(h["text"]))
    return F.sha2(F.concat_ws("\u0001", match_text(situation), F.array_join(texts, "\u0002"), match_text(reference)), 256)


def _alternatives(words: Sequence[str]) -> str:
    return "|".join(w.replace("-", "\\-").replace("\n", "\\n") for w in words)


def clean_prediction(c: Column) -> Column:
    """Stacked prefixes stripped, cut at a next-turn marker, edge quotes trimmed."""
    text = F.regexp_replace(clean(c), f"^(?i)(?:(?:{_alternatives(PREDICTION_PREFIXES)})\\s*)+", "")
    cut = F.regexp_replace(text, f"(?s)(?:{_alternatives(NEXT_TURN_MARKERS)}).*$", "")
    return F.trim(F.regexp_replace(F.trim(cut), r'^"+|"+$', ""))


def clean_response(c: Column) -> Column:
    """Third form: stacked prefixes stripped as they are written, edge quotes trimmed, later turns kept."""
    text = F.regexp_replace(clean(c), f"^(?:(?:{_alternatives(RESPONSE_PREFIXES)})\\s*)+", "")
    return F.trim(F.regexp_replace(F.trim(text), r'^"+|"+$', ""))


def clean_evaluation(c: Column) -> Column:
    """Second form: each prefix once in a fixed order, cut at layout markers, trailing word counts removed."""
    edge = lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")
    text = edge(F.coalesce(c, F.lit("")))
    for p in EVAL_PREFIXES:
        text = edge(F.regexp_replace(text, "^" + p, ""))
    for m in EVAL_MARKERS:
        text = edge(F.substring_index(text, m, 1))
    return edge(F.regexp_replace(text, r"(?i)\s*\(\s*\d+\s+words?\s*\)\s*$", ""))


# ---- Tokens -----------------------------------------------------------------------------------------------

def tokens(c: Column) -> Column:
    """Lower-case runs of letters, digits and apostrophes."""
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(TOKEN), F.lit(1))


def words_by_space(c: Column) -> Column:
    """Number of whitespace-separated words."""
    t = F.regexp_replace(F.coalesce(c, F.lit("")), r"^\s+|\s+$", "")
    return F.when(t == "", F.lit(0)).otherwise(F.size(F.split(t, r"\s+"))).cast("long")


def gram_rows(toks: Column, upto: int) -> Column:
    """Generator of structs (w1..wn): every token with its followers, null past the end.

    The shifted copies are zipped, so no lambda touches the token array and the work is linear.
    """
    shifted = [toks.alias("w1")] + [
        F.slice(toks, F.lit(k), F.greatest(F.size(toks), F.lit(1))).alias(f"w{k}") for k in range(2, upto + 1)
    ]
    return F.explode(F.arrays_zip(*shifted))


def gram(row: str, n: int) -> Column:
    """n-gram text of an exploded gram row, null when it would run past the end."""
    parts: list[Column] = []
    for k in range(1, n + 1):
        parts += [F.col(f"{row}.w{k}"), F.lit(" ")]
    return F.concat(*parts[:-1])


def bigrams(toks: Column) -> Column:
    """Bigram texts of a token array column."""
    nxt = F.slice(toks, F.lit(2), F.greatest(F.size(toks), F.lit(1)))
    return F.filter(F.zip_with(toks, nxt, lambda a, b: F.concat(a, F.lit(" "), b)), lambda g: g.isNotNull())


def trigrams(toks: Column) -> Column:
    nxt = F.slice(toks, F.lit(3), F.greatest(F.size(toks), F.lit(1)))
    return F.filter(F.zip_with(bigrams(toks), nxt, lambda a, b: F.concat(a, F.lit(" "), b)), lambda g: g.isNotNull())


def neighbours_equal(toks: Column) -> Column:
    """Per position whether the next token is the same; null at the last one."""
    return F.zip_with(toks, F.slice(toks, F.lit(2), F.greatest(F.size(toks), F.lit(1))), lambda a, b: a == b)


def duplicates(items: Column) -> Column:
    return F.size(items) - F.size(F.array_distinct(items))


# ---- Flags ------------------------------------------------------------------------------------------------

def is_question(c: Column) -> Column:
    """Contains a question mark or starts with an interrogative or auxiliary word."""
    t = F.coalesce(c, F.lit(""))
    start = r"(?i)^[\s\"'“”‘’(\[]*(?:" + "|".join(QUESTION_WORDS) + r")\b"
    return F.contains(t, F.lit("?")) | F.contains(t, F.lit("？")) | t.rlike(start)


def _normal(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"\s+", " "))


def generic_rules_a(c: Column, toks: Column) -> Column:
    """Exact phrases, at most four words, or a pattern within 24 words."""
    norm = F.lower(clean(c))
    exact = F.regexp_replace(norm, r"[.!?]+$", "").isin(GENERIC_A_EXACT)
    hit = any_of([norm.rlike(p) for p in GENERIC_A_PATTERNS])
    n = F.size(toks)
    return (n > 0) & (exact | (n <= 4) | ((n <= 24) & hit))


def generic_rules_b(c: Column) -> Column:
    """Exact phrases, or a pattern within 20 whitespace words."""
    norm = _normal(c)
    exact = F.regexp_replace(norm, r"[.!?]+$", "").isin(GENERIC_B_EXACT)
    return exact | ((words_by_space(c) <= 20) & any_of([norm.rlike(p) for p in GENERIC_B_PATTERNS]))


def generic_rules_c(c: Column) -> Column:
    """Contains one of the phrases."""
    low = F.lower(clean(c))
    return any_of([F.contains(low, F.lit(p)) for p in GENERIC_C_PHRASES])


def generic_rules_d(c: Column) -> Column:
    """Starts with one of the phrases."""
    low = F.trim(F.lower(F.coalesce(c, F.lit(""))))
    return any_of([F.startswith(low, F.lit(p)) for p in GENERIC_D_STARTS])


def repetition_rules_a(c: Column, toks: Column, tri: Column) -> Column:
    """X11: three equal tokens in a row, a repeated trigram, or a repeated sentence."""
    sentences = F.filter(
        F.transform(F.split(F.coalesce(c, F.lit("")), r"[.!?]+"),
                    lambda s: F.trim(F.regexp_replace(F.lower(s), r"[^a-z0-9']+", " "))),
        lambda s: s != "",
    )
    twice = neighbours_equal(toks)
    after = F.slice(twice, F.lit(2), F.greatest(F.size(twice), F.lit(1)))
    triple = F.coalesce(F.exists(F.zip_with(twice, after, lambda a, b: a & b), lambda x: x), F.lit(False))
    return triple | (duplicates(tri) > 0) | (duplicates(sentences) > 0)


def repetition_share(bi: Column, tri: Column) -> Column:
    """X11: share of repeated bigrams and trigrams."""
    total = F.size(bi) + F.size(tri)
    return F.when(total > 0, (duplicates(bi) + duplicates(tri)) / total).otherwise(0.0)


def duplicate_rate(items: Column) -> Column:
    """X11: share of items that repeat an earlier one."""
    return F.when(F.size(items) > 0, duplicates(items) / F.size(items)).otherwise(0.0)


def repetition_rules_d(toks: Column) -> Column:
    """X11: a token at least three times, or twice in a row.

    Sorted tokens put copies side by side, so "three times" is a comparison two places apart.
    """
    s = F.sort_array(toks)
    third = F.slice(s, F.lit(3), F.greatest(F.size(s), F.lit(1)))
    thrice = F.exists(F.zip_with(s, third, lambda a, b: a == b), lambda x: F.coalesce(x, F.lit(False)))
    pair = F.exists(neighbours_equal(toks), lambda x: x)
    return F.coalesce(thrice, F.lit(False)) | F.coalesce(pair, F.lit(False))


def role_leak(c: Column) -> Column:
    """A role marker at the start of a line."""
    return F.coalesce(c, F.lit("")).rlike(ROLE_MARKER)


def multi_turn_leak(c: Column) -> Column:
    """At least two role markers, any case."""
    return F.regexp_count(F.coalesce(c, F.lit("")), F.lit("(?i)" + ROLE_MARKER)) >= 2


def copy_share(response_tokens: Column, context_tokens: Column) -> Column:
    """Share of the response vocabulary that the context also has."""
    mine = F.size(F.array_distinct(response_tokens))
    both = F.size(F.array_intersect(response_tokens, context_tokens))
    return F.when(mine > 0, both / mine).otherwise(0.0)


def exact_copy(response: Column, target: Column) -> Column:
    """Response and target are the same non-empty text in match form."""
    r = match_text(response)
    return (r != "") & (r == match_text(target))


def jaccard(a: Column, b: Column, empty: float = 0.0) -> Column:
    """Shared over united distinct items; `empty` is the value for two empty sides."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(F.lit(float(empty)))


def recall_overlap(generated: Column, target: Column) -> Column:
    """Share of the target vocabulary that was generated; 0 for an empty target."""
    n = F.size(F.array_distinct(target))
    return F.when(n > 0, F.size(F.array_intersect(generated, target)) / n).otherwise(0.0)


def stripped_words(c: Column) -> Column:
    """Whitespace words in lower case without edge punctuation, blanks removed."""
    edge = f"^[{PUNCTUATION_EDGE}]+|[{PUNCTUATION_EDGE}]+$"
    words = F.transform(F.split(F.coalesce(c, F.lit("")), r"\s+"), lambda w: F.lower(F.regexp_replace(w, edge, "")))
    return F.array_distinct(F.filter(words, lambda w: w != ""))


def length_flags(words: Column) -> dict[str, Column]:
    """Too short, too long, within the band."""
    return {
        "too_short": words < SHORT_BELOW,
        "too_long": words > LONG_ABOVE,
        "length_ok": words.between(SHORT_BELOW, LONG_ABOVE),
    }


def complete_sentence(c: Column) -> Column:
    """Ends with a full stop, exclamation or question mark, optionally closed by quotes or brackets."""
    return F.coalesce(c, F.lit("")).rlike(r"[.!?][\"')\]]*\s*$")


def confidence_bin(c: Column) -> Column:
    """Missing, 1-2, 3 or 4-5; the names of the bins pass through."""
    text = F.trim(c.cast("string"))
    d = text.try_cast("double")
    whole = F.when(d < 0, F.ceil(d)).otherwise(F.floor(d))
    named = F.when(text.isin("1-2", "3", "4-5", "missing"), text).otherwise("missing")
    return F.when(d.isNull() | F.isnan(d), named).when(whole <= 2, "1-2").when(whole == 3, "3").otherwise("4-5")


# ---- Histories --------------------------------------------------------------------------------------------

def parse_history(c: Column) -> Column:
    """Text with `<SEP>` or line breaks to an array of (role, text); roles from `A:`-like heads, else parity."""
    parts = F.transform(F.split(F.coalesce(c, F.lit("")), r"\s*<SEP>\s*|\n+"), lambda p: clean(p))
    head = r"^(?i)(A|B|Speaker|Listener|user|assistant)\s*:\s*(.+)$"

    def turn(p: Column, i: Column) -> Column:
        role = F.regexp_extract(p, head, 1)
        return F.struct(
            canonical_role(role, i).alias("role"),
            F.when(role != "", clean(F.regexp_extract(p, head, 2))).otherwise(p).alias("text"),
        )

    return F.filter(F.transform(parts, turn), lambda t: t["text"] != "")


def serialize_history(history: Column) -> Column:
    """`A: ...` lines."""
    return F.array_join(F.transform(history, lambda t: F.concat(t["role"], F.lit(": "), clean(t["text"]))), "\n")


def input_text(situation: Column, history_text: Column, target: Column) -> Column:
    """Prompt-style input with situation, dialogue history and the next speaker."""
    situ = clean(situation)
    head = F.when(situ != "", F.concat(F.lit("Situation:\n"), situ))
    body = F.when(history_text != "", history_text).otherwise("N/A")
    return F.concat_ws("\n\n", head, F.lit("Dialogue history:"), body, F.concat(F.lit("Next speaker: "), target))


def model_text(situation: Column, context: Column) -> Column:
    """Shorter form with an optional situation line."""
    situ = F.coalesce(situation, F.lit(""))
    head = F.when(situ != "", F.concat(F.lit("Situation: "), situ))
    return F.concat_ws("\n", head, F.lit("Dialogue:"), context)
