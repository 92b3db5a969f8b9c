"""Column -> Column string functions.

All of these are built-in Spark expressions (regexp_replace, split,
higher-order array functions), so they stay inside whole-stage codegen and
never leave the JVM.  Regexes are Java regexes; ``\\d``, ``\\w`` and ``\\s`` are
ASCII classes here.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values.  These must equal the reference behaviour for equal results.
# ---------------------------------------------------------------------------

# Separator placed after every token of a message signature.
SEP = "\x1f"

# Matching tokenizer: characters that split a message into tokens are white
# space and  ! " # $ % & ' ( ) + , - / : ; = ? @ . [ \ ] ^ _ ` { | } ~
# Of the splitters only  = | ( )  are kept as tokens of their own.
TOKEN_CHAR = r"""[^\s!"#$%&'()+,\-/:;=?@.\[\\\]^_`{|}~]"""
TOKEN = TOKEN_CHAR + r"+|[=|()]"

# Variable masks applied to a proposed template, in this order, each
# replaced by <*>: colon-separated hex (MAC-like), IPv4, runs of long hex
# words, runs of four-digit upper hex groups, 0x-hex numbers, signed
# integers, and the quoted command after "executed cmd ".
VARIABLE_MASKS = [
    r"((?<=[^A-Za-z0-9])|^)(([0-9a-f]{2,}:){3,}([0-9a-f]{2,}))((?=[^A-Za-z0-9])|$)",
    r"((?<=[^A-Za-z0-9])|^)(\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3})((?=[^A-Za-z0-9])|$)",
    r"((?<=[^A-Za-z0-9])|^)([0-9a-f]{6,} ?){3,}((?=[^A-Za-z0-9])|$)",
    r"((?<=[^A-Za-z0-9])|^)([0-9A-F]{4} ?){4,}((?=[^A-Za-z0-9])|$)",
    r"((?<=[^A-Za-z0-9])|^)(0x[a-f0-9A-F]+)((?=[^A-Za-z0-9])|$)",
    r"((?<=[^A-Za-z0-9])|^)([\-\+]?\d+)((?=[^A-Za-z0-9])|$)",
    r"(?<=executed cmd )(\".+?\")",
]

# Correction rules.  Token delimiters: white space , ! ; : = | " ' [ ] ( ) { }
# and additionally . - + @ # $ % &.  Path delimiters are the first group only.
PATH_DELIMS = r"""\s,!;:=|"'\[\](){}"""
TOKEN_DELIMS = PATH_DELIMS + r".\-+@#$%&"
# Words that the oracle profile turns into <*> (case-insensitive, whole token).
BOOLEAN_WORDS = ["true", "false"]
DEFAULT_STRINGS = ["null", "root", "admin"]

# Python's string.punctuation as a Java character class (ranges of ASCII).
PUNCT_CLASS = r"!-/:-@\[-`{-~"

# Sampler word statistics: words of at most two characters and these words
# (plus day and month names and their abbreviations) are not counted.
STOPWORDS = ["a", "an", "and", "i", "ie", "so", "to", "the"]
DAY_NAMES = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]
DAY_ABBR = ["Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun"]
MONTH_NAMES = ["January", "February", "March", "April", "May", "June", "July",
               "August", "September", "October", "November", "December"]
MONTH_ABBR = ["Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"]
SAMPLER_STOPWORDS = STOPWORDS + DAY_NAMES + DAY_ABBR + MONTH_NAMES + MONTH_ABBR

# Prompt texts for a model proposer.
SYSTEM_PROMPT = "You are an expert of log parsing, and now you will help to do log parsing."
INSTRUCTION = ("I want you to act like an expert of log parsing. I will give you a log message "
               "delimited by backticks. You must identify and abstract all the dynamic variables "
               "in logs with {placeholder} and output a static log template. Print the input log's "
               "template delimited by backticks.")
ASSISTANT_ACK = "Sure, I can help you with log parsing."
DEFAULT_EXAMPLE_QUERY = "Log message: `try to connected to host: 172.16.254.1, finished.`"
DEFAULT_EXAMPLE_ANSWER = "Log template: `try to connected to host: {ip_address}, finished.`"

WILDCARD = "<*>"
_WILD_RE = r"<\*>"


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


# ---------------------------------------------------------------------------
# G1 matching tokenizer, signatures, template statistics
# ---------------------------------------------------------------------------

def signature(col) -> Column:
    """Token signature of a message or template: every token followed by SEP.

    Tokens that contain ``<*>`` become ``<*>``; a ``<*>`` directly after a
    ``<*>`` is dropped.  Empty input gives ``''``.
    """
    c = _c(col)

    def joined(x):
        return F.array_join(F.concat(F.regexp_extract_all(x, F.lit(TOKEN), 0), F.array(F.lit(""))), SEP)

    marked = F.regexp_replace(c, TOKEN_CHAR + r"*<\*>" + TOKEN_CHAR + r"*", WILDCARD)
    runs = F.regexp_replace(joined(marked), "(?:" + _WILD_RE + SEP + "){2,}", WILDCARD + SEP)
    return F.when(F.contains(c, F.lit(WILDCARD)), runs).otherwise(joined(c))  # most messages hold no wildcard


def group_token(col) -> Column:
    """A single token standing for a dataset (hex of its 64-bit hash)."""
    return F.concat(F.lit("ds"), F.hex(F.xxhash64(_c(col))))


def keyed_signature(col, group_col: str | None = None) -> Column:
    """Signature with the dataset as a leading static token, so templates of
    one dataset only ever meet messages of the same dataset."""
    if not group_col:
        return signature(col)
    return F.concat(group_token(group_col), F.lit(SEP), signature(col))


def sig_tokens(sig) -> Column:
    """Token array of a signature."""
    return F.array_remove(F.split(_c(sig), SEP), "")


def tokens(col) -> Column:
    """G1: matching tokens of a message or template."""
    return sig_tokens(signature(col))


def n_wild(tok) -> Column:
    return F.size(F.filter(_c(tok), lambda t: t == WILDCARD))


def n_static(tok) -> Column:
    return F.size(F.filter(_c(tok), lambda t: t != WILDCARD))


def wildcard_count(col, compat: bool = False) -> Column:
    """Wildcards in a template string (B6).  ``compat`` counts the regex
    ``<*>`` (zero or more ``<`` then ``>``) as the reference's band filter does."""
    if compat:
        return F.regexp_count(_c(col), F.lit("<*>"))
    return F.regexp_count(_c(col), F.lit(_WILD_RE))


def match_pattern(tok) -> Column:
    """Java regex over a signature for a template's tokens.

    A static token must equal the message token; ``<*>`` takes zero or more
    whole tokens: nothing, or anything up to a separator (no group repeats, so
    Java's matcher does not recurse on long lines).  One capture group per
    wildcard (G27).
    """
    parts = F.transform(
        _c(tok),
        lambda t: F.when(t == WILDCARD, F.lit("((?:[\\s\\S]*?" + SEP + ")??)"))
        .otherwise(F.concat(F.lit(r"\Q"), t, F.lit(r"\E" + SEP))))
    return F.concat(F.lit("^"), F.array_join(parts, ""), F.lit("$"))


# ---------------------------------------------------------------------------
# Turning a message or answer into a template
# ---------------------------------------------------------------------------

def placeholders_to_wildcards(col) -> Column:
    """``{name}`` -> ``<*>``."""
    return _replaced(col, r"\{(\w+)\}", "{")


# Java repeats groups by recursion, which ends the JVM on very long runs; possessive repeats need
# none.  The masks of colon-separated hex and of long hex words first try the run as whole words;
# where that finds too few words, the mask itself decides: then it needs few repeats, so a bound of
# FEW takes nothing from it.  The mask of four-digit groups is a run of words, each of whole groups
# and ended by other text; the look ahead sees to it that the fourth group lies in such a word.
FEW = 300
_END, _GAP = "(?![A-Za-z0-9])", "(?: (?=[^A-Za-z0-9]|$))?+"
_QUADS = "(?:[0-9A-F]{4})++"
_RUNS = {0: (r"(([0-9a-f]{2,}:){3,}([0-9a-f]{2,}))", "[0-9a-f]{2,}+(?::[0-9a-f]{2,}+" + _END + "){3,}+"),
         2: (r"([0-9a-f]{6,} ?){3,}", "[0-9a-f]{6,}+(?: [0-9a-f]{6,}+" + _END + "){2,}+" + _GAP)}
_QUAD_RUN = (r"([0-9A-F]{4} ?){4,}", "(?=(?:[0-9A-F]{4} ?){3}" + _QUADS + _END + ")" + _QUADS + "(?: " + _QUADS + _END + ")*+" + _GAP)


def safe_masks() -> list[str]:
    """The variable masks, fit for very long lines; a run of any length is masked."""
    out = list(VARIABLE_MASKS)
    for i, (run, whole) in _RUNS.items():
        out[i] = out[i].replace(run, f"(?:{whole}|{run.replace('{3,}', '{3,%d}' % FEW)})")
    out[3] = out[3].replace(*_QUAD_RUN)
    return out


def _replaced(col, pattern: str, needle: str, whole: str = WILDCARD, regex: bool = False) -> Column:
    """``regexp_replace(col, pattern, whole)``, tried only on texts that hold ``needle``, without which the pattern
    can't match.  The text is a lambda variable, so that it is computed once."""
    def step(x):
        holds = x.rlike(needle) if regex else x.contains(needle)
        return F.when(holds, F.regexp_replace(x, pattern, whole)).otherwise(x)
    return F.get(F.transform(F.array(_c(col)), step), F.lit(0))


#: What a text must hold for each of the variable masks to match: (needle, whether it is a regex).
_MASK_NEEDLES = [(":", False), (".", False), ("[0-9a-f]{6}", True), ("[0-9A-F]{4}", True), ("0x", False), ("[0-9]", True),
                 ("executed cmd ", False)]


def mask_variables(col) -> Column:
    """The seven variable masks, in order."""
    out = _c(col)
    for pat, (needle, regex) in zip(safe_masks(), _MASK_NEEDLES):
        out = _replaced(out, pat, needle, regex=regex)
    return out


def _whole_token(inner: str, delims: str = TOKEN_DELIMS) -> str:
    return r"(?<=^|[" + delims + r"])" + inner + r"(?=[" + delims + r"]|$)"


def _collapse_spaces(col) -> Column:
    return F.regexp_replace(F.regexp_replace(col, r"^\s+|\s+$", ""), r"\s+", " ")


_DG = _whole_token(r"\d+")
_WV = _whole_token(r"[^" + TOKEN_DELIMS + r"/]*<\*>[^" + TOKEN_DELIMS + r"/]*")
_DV = r"<\*>(?:\.<\*>)+"
_CV = r"(?:<\*>){2,}"


def correct_template(col) -> Column:
    """Parser-profile correction (DS, DG, WV, DV, CV, then separator and
    quote collapsing).  Apply exactly once: the chain is not idempotent."""
    t = _collapse_spaces(_c(col))
    t = _replaced(t, _DG, "[0-9]", regex=True)
    t = _replaced(t, _WV, WILDCARD)
    t = _replaced(t, _DV, "<*>.<*>")
    t = _replaced(t, _CV, "<*><*>")
    t = _replaced(t, r"(?<= )#<\*>#(?= )", "#<*>#")
    t = _replaced(t, r"(?<= )#<\*>(?= )", "#<*>")
    for sep in [":", "#", "/", "@", r"\."]:
        t = _replaced(t, r"<\*>(?:" + sep + r"<\*>)+", "<*>" + sep[-1] + "<*>")
    t = _replaced(t, r"""(?<= )"<\*>"(?= )""", '"<*>"')
    t = _replaced(t, r"""(?<= )'<\*>'(?= )""", "'<*>'")
    return _replaced(t, _CV, "<*><*>")


def correct_oracle_template(col, user_strings: list[str] | None = None) -> Column:
    """Oracle-profile correction (DS, PS, BL, US, DG, WV, DV, CV)."""
    words = BOOLEAN_WORDS + DEFAULT_STRINGS + [w for w in (user_strings or [])
                                                if w.lower() not in BOOLEAN_WORDS + DEFAULT_STRINGS]
    alt = "|".join(r"\Q" + w + r"\E" for w in words)
    t = _collapse_spaces(_c(col))
    t = F.regexp_replace(t, _whole_token(r"(?:/[^/" + PATH_DELIMS + r"]+)+", PATH_DELIMS), WILDCARD)
    t = F.regexp_replace(t, "(?i)" + _whole_token("(?:" + alt + ")"), WILDCARD)
    t = F.regexp_replace(t, _DG, WILDCARD)
    t = F.regexp_replace(t, _WV, WILDCARD)
    t = F.regexp_replace(t, _DV, WILDCARD)
    return F.regexp_replace(t, _CV, WILDCARD)


def is_too_general(col) -> Column:
    """Static part has nothing but spaces and punctuation."""
    static = F.regexp_replace(_c(col), _WILD_RE, "")
    return ~static.rlike("[^ " + PUNCT_CLASS + "]")


def clean_template(col) -> Column:
    """G4 -> G5 -> G6 (no too-general check)."""
    return correct_template(mask_variables(placeholders_to_wildcards(col)))


def propose_template(col) -> Column:
    """The template a message gets without a model; NULL when the
    result is too general (B10) or has no tokens (B11)."""
    # a lambda variable: the clean-up is computed once, not once for the test and once for the result
    return F.get(F.transform(F.array(clean_template(col)), lambda t: F.when(is_too_general(t), F.lit(None).cast("string")).otherwise(t)), F.lit(0))


# ---------------------------------------------------------------------------
# Scoring tokenizer and token similarity
# ---------------------------------------------------------------------------

_SCORE_DELIM = r"""\s!"#$%&'()+,\-/:;=?@.\[\\\]^_`{|}~"""


def score_tokens(col) -> Column:
    """As G1 but a run of delimiters is one piece, of which only
    ``= | ( )`` survive (so ``=(`` is one token)."""
    runs = F.regexp_extract_all(_c(col), F.lit("[^" + _SCORE_DELIM + "]+|[" + _SCORE_DELIM + "]+"), 0)
    cleaned = F.transform(
        runs,
        lambda r: F.when(r.contains(WILDCARD), F.lit(WILDCARD))
        .otherwise(F.regexp_replace(r, r"""[\s!"#$%&'+,\-/:;?@.\[\\\]^_`{}~]""", "")))
    joined = F.concat(F.array_join(F.array_remove(cleaned, ""), SEP), F.lit(SEP))
    collapsed = F.regexp_replace(joined, "(?:" + _WILD_RE + SEP + "){2,}", WILDCARD + SEP)
    return F.array_remove(F.split(collapsed, SEP), "")


def token_similarity(a, b) -> Column:
    """|set(a) & set(b)| / (len(a) + len(b) - |set(a) & set(b)|) on G2 tokens."""
    ta, tb = score_tokens(a), score_tokens(b)
    inter = F.size(F.array_intersect(ta, tb))
    return inter.cast("double") / (F.size(ta) + F.size(tb) - inter)


# ---------------------------------------------------------------------------
# Sampler cleaning
# ---------------------------------------------------------------------------

def _words(col) -> Column:
    return F.array_remove(F.split(F.regexp_replace(col, r"^\s+|\s+$", ""), r"\s+"), "")


def sampler_signature(col) -> Column:
    """G9 signature: sorted distinct characters outside ``[0-9A-Za-z, ]``."""
    rest = F.regexp_replace(_c(col), "[0-9A-Za-z, ]+", "")
    return F.array_join(F.array_sort(F.array_distinct(F.array_remove(F.split(rest, ""), ""))), "")


def sampler_words(col) -> Column:
    """G9 words: cut at specials and white space (one pass over the text), drop words with a digit."""
    s = F.replace(_c(col), F.lit(".!"), F.lit(" "))
    found = F.array_remove(F.split(s, r"""[\s:()=,"{}@\[\]|;!]+"""), "")
    return F.filter(found, lambda w: ~w.rlike("[0-9]"))


def sampler_clean(col) -> Column:
    """G9 text: the cleaned words joined by single spaces."""
    return F.array_join(sampler_words(col), " ")


def words(col) -> Column:
    """Whitespace words (Python ``str.split()``)."""
    return _words(_c(col))


def vocab_words(col) -> Column:
    """Words longer than two characters that are not stopwords."""
    stop = F.array(*[F.lit(w) for w in SAMPLER_STOPWORDS])
    return F.filter(words(col), lambda w: (F.length(w) > 2) & ~F.array_contains(stop, w))


def farthest_clean(col) -> Column:
    """Clean-up for farthest-point sampling."""
    s = F.regexp_replace(_c(col), r"""[:()=,"{}@\[\]|;.]|$""", " ")
    s = F.array_join(F.transform(_words(s), lambda w: F.when(
        (F.upper(w) == w) & (F.lower(w) != w), F.lower(w)).otherwise(w)), " ")
    s = F.regexp_replace(F.regexp_replace(s, "([A-Z]+)", " $1"), "([A-Z][a-z]+)", " $1")
    s = F.array_join(F.filter(_words(s), lambda w: ~w.rlike(r"\d")), " ")
    s = F.regexp_replace(s, "[" + PUNCT_CLASS + "]", "")
    return F.array_join(F.transform(_words(s), lambda w: F.lower(w)), " ")


# ---------------------------------------------------------------------------
# Template comparisons
# ---------------------------------------------------------------------------

def template_regex(col) -> Column:
    """Template -> anchored regex; ``<*>`` -> ``(\\S+?)``, each white
    space -> ``\\s+``, everything else literal."""
    esc = F.regexp_replace(_c(col), r"([\\^$.|?*+()\[\]{}])", r"\\$1")
    esc = F.regexp_replace(esc, r"\s", r"\\s+")
    esc = F.regexp_replace(esc, r"<\\\*>", r"(\\S+?)")
    return F.concat(F.lit("^"), esc, F.lit("$"))


def is_abstract(x, y) -> Column:
    """Template x matches y (y a template or message); NULL y -> false."""
    return F.coalesce(F.rlike(_c(y), template_regex(x)), F.lit(False))


def relaxed_tokens(col) -> Column:
    """G20 helper: split on single spaces; tokens containing <*> become <*>."""
    return F.transform(F.split(_c(col), " "), lambda t: F.when(t.contains(WILDCARD), F.lit(WILDCARD)).otherwise(t))


def relaxed_equal(relaxed_side, other) -> Column:
    """``relaxed_tokens(relaxed_side) == split(other, ' ')``; NULL -> false."""
    return F.coalesce(relaxed_tokens(relaxed_side) == F.split(_c(other), " "), F.lit(False))


# ---------------------------------------------------------------------------
# Prompt and answer text
# ---------------------------------------------------------------------------

def parse_answer(col) -> Column:
    """Template text out of a model answer, NULL when none is found."""
    lines = F.split(_c(col), "\n")
    line = F.coalesce(F.try_element_at(F.filter(lines, lambda l: F.instr(l, "Log template:") > 0), F.lit(1)),
                      F.try_element_at(F.filter(lines, lambda l: F.instr(l, "`") > 0), F.lit(1)))
    in_ticks = F.regexp_extract(line, r"(?s)`(.*)`", 1)
    in_quotes = F.regexp_extract(line, r'(?s)"(.*)"', 1)
    picked = F.when(F.instr(line, "`") > 0, in_ticks).otherwise(in_quotes)
    return F.when(picked != "", picked)


def render_example_query(col) -> Column:
    """G22."""
    return F.concat(F.lit("Log message: `"), _c(col), F.lit("`"))


def render_example_answer(col) -> Column:
    """G22."""
    return F.concat(F.lit("Log template: `"), _c(col), F.lit("`"))


def wildcards_to_placeholder(col) -> Column:
    """``<*>`` -> ``{variables}``."""
    return F.replace(_c(col), F.lit(WILDCARD), F.lit("{variables}"))


def metric_round(col, digits: int = 3) -> Column:
    """G30."""
    return F.round(_c(col), digits)
