"""Template matching as a blocked join.

A message matches a template when the template's tokens, read as a glob
over whole tokens (``<*>`` takes zero or more tokens), cover the message's
tokens.  The join is blocked so that no message is compared with every
template:

* templates that start with static tokens join on the first
  ``min(3, leading static run)`` tokens (an equi-join, exact because those
  tokens must equal the message prefix);
* templates that start with ``<*>``, and those whose block key more than
  ``CROWDED`` templates share, join on their anchor: of their static tokens the one
  that the fewest messages hold (tokens of the message exploded); a message that
  lacks another static token of the template goes before the pattern is tried.

The residual test compares the message signature with the text around the template's
wildcards; with more than two of them it is one ``RLIKE`` against the template's pattern.  The template side is broadcast only after its size has
been measured; above the limit the same plan runs as a shuffled join and AQE
splits hot blocks.  The winner per message is the most static tokens, then
fewest wildcards, then static-before-wildcard position order, then the
smaller template id.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.functions.text import (SEP, WILDCARD, group_token, keyed_signature, match_pattern, n_static, n_wild,
                                    sig_tokens, signature)
from logloom.session import cut_lineage

BLOCK_DEPTH = 3
# Templates under one block key up to which the key alone selects candidates.
CROWDED = 16
# A line feed is white space and so never part of a token.
PARAM_MARK = "\n"
# Template tables up to this many bytes (patterns + text) are broadcast.
BROADCAST_BYTES = 64 * 1024 * 1024


def prepare_templates(templates: DataFrame, id_col: str = "template_id",
                      template_col: str = "template", group_col: str | None = None) -> DataFrame:
    """Template table -> tokens, pattern, statistics and block keys.

    Empty templates and the bare ``<*>`` are dropped (B11).  With
    ``group_col`` the dataset is the leading token of every template."""
    extra = [group_col] if group_col else []
    # exploded (one row a template, none if it is dropped): a filter would repeat the signature's regexes
    kept = F.filter(F.array(signature(template_col)), lambda s: (s != "") & (s != WILDCARD + SEP))
    t = templates.select(F.col(id_col).alias("template_id"), F.col(template_col).alias("template"), *extra, F.explode(kept).alias("t_sig"))
    if group_col:
        t = t.withColumn("t_sig", F.concat(group_token(group_col), F.lit(SEP), F.col("t_sig")))
    t = t.withColumn("t_tokens", sig_tokens("t_sig"))
    first_wild = F.array_position("t_tokens", WILDCARD)
    lead = F.when(first_wild == 0, F.size("t_tokens")).otherwise(first_wild - 1)
    t = (t.withColumn("n_static", n_static("t_tokens"))
         .withColumn("n_wild", n_wild("t_tokens"))
         .withColumn("wild_flags", F.transform("t_tokens", lambda x: x == WILDCARD))
         .withColumn("depth", F.least(lead, F.lit(BLOCK_DEPTH)).cast("int"))
         .withColumn("block_key", F.array_join(F.slice("t_tokens", 1, F.col("depth")), SEP))
         .withColumn("anchor", F.try_element_at(F.filter("t_tokens", lambda x: x != WILDCARD), F.lit(1)))
         .withColumn("pattern", match_pattern("t_tokens"))
         .withColumn("parts", F.split(F.array_join(F.concat("t_tokens", F.array(F.lit(""))), SEP), r"<\*>" + SEP, -1)))
    return t


def stored_templates(templates: DataFrame, group_col: str | None = None) -> DataFrame:
    """``prepare_templates``, computed once and written: the blocked join reads it several times."""
    return cut_lineage(prepare_templates(templates, group_col=group_col), "match-templates")


def _fits():
    """The pattern's test of a signature against a prepared template's ``parts`` (the text before, between and after its wildcards).

    A part ends with a separator or is empty, so up to two wildcards need no regex: the signature starts
    with the first part, ends with the last one at a token's start, and the middle one stands between them at a
    token's start.  With more wildcards the pattern decides, if the message holds every static token."""
    sig, sep, first, last = F.col("sig"), F.lit(SEP), F.get("parts", F.lit(0)), F.get("parts", F.col("n_wild"))
    between = F.length(sig) - F.length(first) - F.length(last)
    middle = F.substring(sig, F.length(first) + 1, between)
    rest = (F.size(F.array_except("t_tokens", F.concat(sig_tokens(sig), F.array(F.lit(WILDCARD))))) == 0) & F.rlike(sig, F.col("pattern"))
    inner = (F.when(F.col("n_wild") == 1, F.lit(True)).when(F.col("n_wild") == 2, F.contains(F.concat(sep, middle), F.concat(sep, F.get("parts", F.lit(1)))))
             .otherwise(rest))
    wild = (between >= 0) & F.endswith(F.concat(sep, sig), F.concat(sep, last)) & inner
    return F.startswith(sig, first) & F.when(F.col("n_wild") == 0, sig == first).otherwise(wild)


def _size_checked(df: DataFrame, limit: int | None = None) -> bool:
    limit = BROADCAST_BYTES if limit is None else limit
    row = df.agg(F.count("*").alias("n"),
                 F.sum(F.length("pattern") + F.length("template") + 64).alias("b")).first()
    return row is not None and (row["b"] or 0) <= limit


# Of the tokens that are no template's anchor, this many frequent ones never leave their messages' tasks.
COMMON_TOKENS = 100_000
# Templates whose anchor more messages hold than this meet them without a shuffle, if they are few.
HOT_ANCHOR, HOT_TEMPLATES = 100_000, 1_000


def token_counts(sigs: DataFrame) -> DataFrame:
    """Signatures that hold each token (map-side first): tok, n."""
    return sigs.select(F.explode(F.array_distinct(sig_tokens("sig"))).alias("tok")).groupBy("tok").agg(F.count("*").alias("n"))


def frequent_tokens(counts: DataFrame) -> DataFrame:
    """The ``COMMON_TOKENS`` tokens that the most signatures hold: tok, n."""
    return cut_lineage(counts.orderBy(F.col("n").desc()).limit(COMMON_TOKENS), "frequent-tokens")


def corpus_anchors(tp: DataFrame, sigs: DataFrame, counts: DataFrame | None = None, frequent: DataFrame | None = None) -> DataFrame:
    """The inverted index's keys: each prepared template's ``anchor`` is its corpus-rarest static
    token (the fewest signatures hold it; ties: the smaller token).

    A token that no signature holds is rarest of all and gives no candidate.  ``counts`` and ``frequent``: ``token_counts(sigs)``
    and its ``frequent_tokens``, if they were made before.  Frequent tokens get their counts in the template's task, where all
    of a template make one row; only the others are shuffled.  The column ``held`` is the number of signatures that hold the anchor."""
    counts = cut_lineage(token_counts(sigs), "token-counts") if counts is None else counts
    frequent = frequent_tokens(counts) if frequent is None else frequent
    owned = tp.select("template_id", "t_sig", F.explode(F.array_distinct(F.array_remove("t_tokens", WILDCARD))).alias("tok"))
    near = owned.join(F.broadcast(frequent), "tok")
    far = owned.join(F.broadcast(frequent.select("tok")), "tok", "left_anti").join(counts, "tok", "left")
    rank = F.struct(F.coalesce("n", F.lit(0)).alias("n"), "tok")
    rarest = near.unionByName(far).groupBy("template_id", "t_sig").agg(F.min(rank).alias("r"))
    rarest = rarest.select("template_id", "t_sig", F.col("r.tok").alias("anchor"), F.col("r.n").alias("held"))
    return tp.drop("anchor").join(rarest, ["template_id", "t_sig"], "left")


# Bits for each anchor in the map of their hashes, the most 64-bit words of the map (32 MiB, broadcast), and words a row.
ANCHOR_BITS, ANCHOR_WORDS, ROW_WORDS = 16, 1 << 22, 1 << 10


def held_by_anchors(tokens: DataFrame, anchors: DataFrame) -> DataFrame:
    """The rows of ``tokens`` (m_tok) whose token may be one of ``anchors`` (anchor): all that are, and the few others whose hash
    falls on an anchor's bit.  The tokens are not shuffled for it."""
    words, n = ROW_WORDS, anchors.count()
    while words < ANCHOR_WORDS and words * 64 < n * ANCHOR_BITS:
        words *= 2
    bit = lambda c: F.xxhash64(c).bitwiseAND(words * 64 - 1)
    place = lambda c: bit(c).bitwiseAND(63).cast("int")
    ones = anchors.select(F.shiftright(bit("anchor"), 6).alias("id"), F.call_function("shiftleft", F.lit(1).cast("long"), place("anchor")).alias("bits"))
    ones = ones.groupBy("id").agg(F.bit_or("bits").alias("bits"))
    every = tokens.sparkSession.range(words).join(ones, "id", "left").select("id", F.coalesce("bits", F.lit(0)).alias("bits"))
    rows = every.groupBy(F.floor(F.col("id") / ROW_WORDS).alias("_row")).agg(F.array_sort(F.collect_list(F.struct("id", "bits")))["bits"].alias("_bits"))
    rows = cut_lineage(rows, "anchor-bits")
    word = F.shiftright(bit("m_tok"), 6)
    taken = F.call_function("shiftright", F.get("_bits", word.bitwiseAND(ROW_WORDS - 1).cast("int")), place("m_tok")).bitwiseAND(1) == 1
    return tokens.join(F.broadcast(rows), (F.col("_row") == F.floor(word / ROW_WORDS)) & taken).select(*tokens.columns)


def all_matches(sigs: DataFrame, tp: DataFrame, carry=(), broadcast: bool | None = None) -> DataFrame:
    """C1 for distinct signatures and prepared templates (stored, if they are many): a row (sig, template_id, template, n_static,
    n_wild, wild_flags, pattern and the template columns ``carry``) for every match."""
    tp = tp.select("template_id", "template", "t_sig", "t_tokens", "n_static", "n_wild", "wild_flags", "depth", "block_key", "pattern", "parts", "anchor", *carry)
    led = tp.filter(F.col("depth") > 0)
    block = ["depth", "block_key"]
    crowded = led.groupBy(*block).agg(F.count("*").alias("crowd")).filter(F.col("crowd") > CROWDED).select(*block)
    crowded = cut_lineage(crowded, "crowded-keys")
    keyed = led.join(crowded, block, "left_anti")
    loose = tp.filter(F.col("depth") == 0).unionByName(led.join(crowded, block, "left_semi").select(*tp.columns))
    depths = sorted(r["depth"] for r in keyed.select("depth").distinct().collect())
    if broadcast is None:
        broadcast = _size_checked(tp)
    keys = sigs.select("sig").filter(F.col("sig") != "")
    cols = ["sig", "template_id", "template", "n_static", "n_wild", "wild_flags", "pattern", *carry]
    cand = []
    if depths:
        size = F.size("m_tokens")
        a = keys.withColumn("m_tokens", sig_tokens("sig")).select("sig", F.explode(F.filter(F.array(*[
            F.when(size >= d, F.struct(F.lit(d).alias("d"), F.array_join(F.slice("m_tokens", 1, d), SEP).alias("k"))) for d in depths]),
            lambda e: e.isNotNull())).alias("m"))
        a = a.select("sig", F.col("m.d").alias("m_depth"), F.col("m.k").alias("m_key"))
        side = F.broadcast(keyed) if broadcast else keyed
        cand.append(a.join(side, (a["m_depth"] == side["depth"]) & (a["m_key"] == side["block_key"]), "inner").filter(_fits()).select(*cols))
    if not loose.isEmpty():
        counts = cut_lineage(token_counts(keys), "token-counts")
        frequent = frequent_tokens(counts)
        loose = cut_lineage(corpus_anchors(loose, keys, counts, frequent), "anchored")
        b = keys.select("sig", F.explode(F.array_distinct(sig_tokens("sig"))).alias("m_tok"))
        hot = loose.filter(F.col("held") > HOT_ANCHOR)
        sides = [F.broadcast(loose)]
        if not broadcast:
            few_hot = hot.limit(HOT_TEMPLATES + 1).count() <= HOT_TEMPLATES
            rest = loose.filter(F.coalesce(F.col("held") <= HOT_ANCHOR, F.lit(True))) if few_hot else loose
            least = frequent.agg(F.min("n")).first()[0] or 0  # an anchor that is frequent is held as often
            common = frequent.join(rest.filter(F.col("held") >= least).select(F.col("anchor").alias("tok")), "tok", "left_anti")
            common = cut_lineage(common.select(F.col("tok").alias("m_tok")), "common-tokens")
            sides = [rest, F.broadcast(hot)] if few_hot else [rest]
        for i, side in enumerate(sides):
            left = b if broadcast or i else held_by_anchors(b.join(F.broadcast(common), "m_tok", "left_anti"), rest.select("anchor"))
            cand.append(left.join(side, left["m_tok"] == side["anchor"], "inner").filter(_fits()).select(*cols))
    if not cand:
        return keys.join(tp.limit(0), F.lit(False)).select(*cols)
    return reduce(DataFrame.unionByName, cand)


def _winners(sigs: DataFrame, tp: DataFrame, broadcast: bool | None, with_params: bool) -> DataFrame:
    """E2 for distinct signatures that match: ``_sig_hash`` (the signature's hash; rows are sorted by it, as many signatures begin
    alike), sig, template_id, template and, with ``with_params``, params."""
    cand = all_matches(sigs, tp, broadcast=broadcast).withColumn("_sig_hash", F.xxhash64("sig"))
    rank = F.struct((-F.col("n_static")).alias("a"), F.col("n_wild").alias("b"),
                    F.col("wild_flags").alias("c"), F.col("template_id").alias("d"))
    wanted = ["template_id", "template", *(["pattern"] if with_params else [])]
    win = cand.groupBy("_sig_hash", "sig").agg(F.min_by(F.struct(*wanted), rank).alias("w"))
    win = win.select("_sig_hash", "sig", *[f"w.{c}" for c in wanted])
    if with_params:
        win = win.withColumn("params", match_params("sig", "pattern"))
    return win.drop("pattern")


def _with_winners(rows: DataFrame, win: DataFrame) -> DataFrame:
    return rows.withColumn("_sig_hash", F.xxhash64("sig")).join(win, ["_sig_hash", "sig"], "left").drop("_sig_hash")


def best_match(sigs: DataFrame, templates: DataFrame, prepared: bool = False,
               broadcast: bool | None = None, with_params: bool = False, group_col: str | None = None) -> DataFrame:
    """C1 + E2 on distinct signatures.

    ``sigs`` has a ``sig`` column (any other columns are carried).  Returns
    ``sigs`` plus ``template_id``, ``template`` (NULL when nothing matches)
    and, with ``with_params``, ``params`` (G27).
    """
    tp = templates if prepared else stored_templates(templates, group_col)
    return _with_winners(sigs, _winners(sigs, tp, broadcast, with_params))


def match_params(sig_col: str, pattern_col: str):
    """Text eaten by each wildcard, its tokens joined without separator.

    The pattern runs once: the signature is replaced by its captured groups, each
    behind a mark, and split at the marks (the mark is no token character)."""
    n = F.regexp_count(F.col(pattern_col), F.lit(r"\(\(\?:"))
    marks = F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.concat(F.lit(PARAM_MARK + "$"), i.cast("string"))), "")
    taken = F.split(F.replace(F.regexp_replace(F.col(sig_col), F.col(pattern_col), marks), F.lit(SEP), F.lit("")), PARAM_MARK)
    return F.when(n > 0, F.slice(taken, 2, n)).otherwise(F.array().cast("array<string>"))  # no wildcard: no params


# Leading-wildcard templates are carried as a literal array in map-side mode.
MAX_LITERAL_TEMPLATES = 256


def _cand_struct():
    return F.struct((-F.col("n_static")).alias("a"), F.col("n_wild").alias("b"), F.col("wild_flags").alias("c"),
                    F.col("template_id").alias("d"), F.col("template").alias("template"),
                    F.col("pattern").alias("pattern"), F.col("n_static").alias("n_static"),
                    F.col("anchor").alias("anchor"))


class Matcher:
    """A template table prepared once for map-side matching (see
    ``match_lines``): block tables, the literal array of leading-wildcard
    templates and the element type.  Build with ``build_matcher``."""

    def __init__(self, tp: DataFrame, lw, elem, group_col: str | None):
        self.tp, self.lw, self.elem, self.group_col = tp, lw, elem, group_col
        self.blocks = tp.filter(F.col("depth") > 0).groupBy("depth", "block_key").agg(
            F.array_sort(F.collect_list(_cand_struct())).alias("cands"))

    def apply(self, df: DataFrame, content_col: str = "Content", with_params: bool = False,
              sig_col: str | None = None) -> DataFrame:
        x = df.withColumn("sig", F.col(sig_col) if sig_col else keyed_signature(content_col, self.group_col))
        x = x.withColumn("_tok", sig_tokens("sig"))
        for d in range(1, BLOCK_DEPTH + 1):
            bd = self.blocks.filter(F.col("depth") == d).select(F.col("block_key").alias(f"_k{d}"),
                                                                F.col("cands").alias(f"_c{d}"))
            x = x.withColumn(f"_k{d}", F.when(F.size("_tok") >= d, F.array_join(F.slice("_tok", 1, d), SEP)))
            x = x.join(F.broadcast(bd), f"_k{d}", "left")
        empty = F.array().cast(f"array<{self.elem.simpleString()}>")
        cands = F.concat(*[F.coalesce(F.col(f"_c{d}"), empty) for d in range(1, BLOCK_DEPTH + 1)],
                         F.filter(self.lw, lambda c: F.array_contains(F.col("_tok"), c["anchor"])))
        # best first, and no pattern is compiled after one that fits
        x = x.withColumn("_w", F.aggregate(F.array_sort(cands), F.lit(None).cast(self.elem), lambda won, c: F.when(won.isNotNull(), won).when(
            (F.size(F.col("_tok")) >= c["n_static"]) & F.rlike(F.col("sig"), c["pattern"]), c)))
        x = x.withColumn("template_id", F.col("_w.d")).withColumn("template", F.col("_w.template"))
        if with_params:
            x = x.withColumn("_p", F.col("_w.pattern")).withColumn(
                "params", F.when(F.col("_p").isNotNull(), match_params("sig", "_p"))).drop("_p")
        return x.drop("_tok", "_w", *[f"_k{d}" for d in range(1, BLOCK_DEPTH + 1)],
                      *[f"_c{d}" for d in range(1, BLOCK_DEPTH + 1)])


def build_matcher(templates: DataFrame, prepared: bool = False, group_col: str | None = None) -> Matcher | None:
    """Prepare a template table for map-side matching, or None when it is
    too large (bytes over the broadcast limit, or more than
    ``MAX_LITERAL_TEMPLATES`` templates that start with a wildcard or share a block
    key: the inverted index of ``all_matches`` finds those with fewer tries)."""
    tp = templates if prepared else prepare_templates(templates, group_col=group_col)
    if not _size_checked(tp):
        return None
    crowd = tp.filter(F.col("depth") > 0).groupBy("depth", "block_key").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0]
    if (crowd or 0) > MAX_LITERAL_TEMPLATES:
        return None
    lw_rows = tp.filter(F.col("depth") == 0).select(_cand_struct().alias("c")).limit(MAX_LITERAL_TEMPLATES + 1).collect()
    if len(lw_rows) > MAX_LITERAL_TEMPLATES:
        return None
    elem = tp.select(_cand_struct().alias("c")).schema["c"].dataType
    lw = F.array(*[_lit_struct(r["c"], elem) for r in lw_rows]) if lw_rows \
        else F.array().cast(f"array<{elem.simpleString()}>")
    return Matcher(tp, lw, elem, group_col)


def match_lines(df: DataFrame, templates: DataFrame, content_col: str = "Content",
                with_params: bool = False, prepared: bool = False, sig_col: str | None = None,
                group_col: str | None = None) -> DataFrame | None:
    """C1 + E2 without any shuffle of the lines (map-side mode).

    The templates are grouped into one row per block key (their candidate
    lists sorted by the winner rule) and joined to the lines with three
    broadcast hash joins (prefix depth 1, 2, 3); templates that start with
    ``<*>`` ride along as a literal array, tested only when their anchor token
    is in the message.  The winner is the first of the sorted candidates whose
    pattern matches.  Returns None when the template table is too large for
    this mode (the caller then uses the distinct-signature join)."""
    m = build_matcher(templates, prepared, group_col)
    return None if m is None else m.apply(df, content_col, with_params, sig_col)


def _lit_struct(row, elem):
    vals = []
    for f in elem.fields:
        v = row[f.name]
        if f.name == "c":
            vals.append(F.array(*[F.lit(b) for b in v]).alias("c"))
        else:
            vals.append(F.lit(v).cast(f.dataType).alias(f.name))
    return F.struct(*vals)


def match_messages(df: DataFrame, templates: DataFrame, content_col: str = "Content",
                   with_params: bool = False, mode: str = "auto", group_col: str | None = None) -> DataFrame:
    """C1 for a line table.

    ``mode="auto"`` uses the map-side matcher when the template table passes
    the size checks, else ``"distinct"``: signature -> distinct signatures
    (map-side partial aggregate) -> blocked join -> join back to the lines,
    left to AQE (broadcast when the matched table is small at run time,
    else a shuffled join with skew splitting)."""
    tp = stored_templates(templates, group_col)
    if mode in ("auto", "map"):
        out = match_lines(df, tp, content_col, with_params, prepared=True, group_col=group_col)
        if out is not None:
            return out
    x = df.withColumn("sig", keyed_signature(content_col, group_col))
    sigs = cut_lineage(x.groupBy("sig").agg(F.count("*").alias("_n")).select("sig"), "signatures")  # read several times
    return _with_winners(x, _winners(sigs, tp, None, with_params))


def unmatched(matched: DataFrame) -> DataFrame:
    """Rows without a template."""
    return matched.filter(F.col("template_id").isNull())


def attach_templates(lines: DataFrame, templates: DataFrame, id_col: str = "template_id") -> DataFrame:
    """Template id -> template string."""
    return lines.join(templates.select(id_col, F.col("template").alias("EventTemplate")), id_col, "left")


def event_numbers(firsts: DataFrame, template_col: str, group_cols=(), known: DataFrame | None = None) -> DataFrame:
    """E1 for a table of first appearances (groups, template, ``_first``): groups, template, number of the
    templates that ``known`` (groups, template, number) lacks; they follow its largest number."""
    from logloom.session import ranked
    g = list(group_cols)
    if known is not None:
        firsts = firsts.join(known.select(*g, template_col), [*g, template_col], "left_anti")
    ids = ranked(firsts, [*g, "_first", template_col], "_rank")
    if g:  # the rank inside a group: less the ranks of the groups before it
        ids = ids.join(ids.groupBy(*g).agg((F.min("_rank") - 1).alias("_before")), g)
    else:
        ids = ids.withColumn("_before", F.lit(0))
    number = F.col("_rank") - F.col("_before")
    if known is not None:
        most = known.groupBy(*g).agg(F.max("number").alias("_most"))
        ids = ids.join(most, g, "left") if g else ids.withColumn("_most", F.lit(most.first()["_most"]).cast("long"))
        number = number + F.coalesce("_most", F.lit(0))
    return cut_lineage(ids.select(*g, template_col, number.cast("long").alias("number")), "event-numbers")


def event_ids(firsts: DataFrame, template_col: str, group_cols=()) -> DataFrame:
    """E1 for a table of first appearances (groups, template, ``_first``): groups, template, EventId."""
    ids = event_numbers(firsts, template_col, group_cols)
    return ids.select(*group_cols, template_col, F.concat(F.lit("E"), F.col("number").cast("string")).alias("EventId"))


def assign_event_ids(parsed: DataFrame, template_col: str = "EventTemplate",
                     order_col: str = "LineId", group_cols=()) -> DataFrame:
    """``E1, E2, ...`` per template in order of first appearance.

    The first appearance per template is a partial aggregate; the templates
    are ranked by ranges (``ranked``), and the ids reach the lines through a
    broadcast join when the table is small."""
    g = list(group_cols)
    firsts = (parsed.filter(F.col(template_col).isNotNull())
              .groupBy(*g, template_col).agg(F.min(order_col).alias("_first")))
    ids = event_ids(firsts, template_col, g)
    ids = F.broadcast(ids) if ids.count() <= 2_000_000 else ids
    return parsed.join(ids, g + [template_col], "left")


def template_table(parsed: DataFrame, template_col: str = "EventTemplate", group_cols=()) -> DataFrame:
    """A9 template table: EventId, EventTemplate, Occurrences."""
    g = list(group_cols)
    return (parsed.filter(F.col(template_col).isNotNull())
            .groupBy(*g, "EventId", template_col).agg(F.count("*").alias("Occurrences")))


def relevant_templates(sigs: DataFrame, templates: DataFrame) -> DataFrame:
    """For each signature, the templates under the longest token prefix
    it shares with any template (at least one token).

    Every prefix of a shared prefix is shared, so the longest one is found by binary search
    over its length: each round joins the signatures, one row each, with the
    distinct prefixes of the templates (128-bit hashes), about log2 of the longest template
    times.  Only then do messages and templates meet, at that one prefix."""
    def hashes(prefix):
        return F.xxhash64(prefix), F.xxhash64(F.lit("second"), prefix)

    tp = prepare_templates(templates).select("template", "t_tokens")
    tp = tp.select("template", F.explode(F.sequence(F.lit(1), F.size("t_tokens"))).alias("k"), "t_tokens")
    tp = tp.withColumn("_p", F.array_join(F.slice("t_tokens", 1, F.col("k")), SEP))
    h1, h2 = hashes(F.col("_p"))
    tp = cut_lineage(tp.select("template", "k", h1.alias("h1"), h2.alias("h2")), "template-prefixes")
    known = cut_lineage(tp.select("k", "h1", "h2").distinct(), "prefixes")
    longest = known.agg(F.max("k")).first()[0] or 0
    m = sigs.select("sig").withColumn("m_tokens", sig_tokens("sig")).filter(F.size("m_tokens") > 0)
    m = m.withColumn("lo", F.lit(0)).withColumn("hi", F.least(F.size("m_tokens"), F.lit(longest)))
    for _ in range(longest.bit_length()):
        m = m.withColumn("mid", F.ceil((F.col("lo") + F.col("hi")) / 2).cast("int"))  # lo once the search has ended
        m = m.withColumn("_p", F.array_join(F.slice("m_tokens", 1, F.col("mid")), SEP))
        h1, h2 = hashes(F.col("_p"))
        m = m.withColumn("m1", h1).withColumn("m2", h2).drop("_p")
        m = m.join(known.withColumn("shared", F.lit(True)), (F.col("mid") == F.col("k")) & (F.col("m1") == F.col("h1")) & (F.col("m2") == F.col("h2")), "left")
        shared = F.coalesce("shared", F.lit(False)) | (F.col("mid") == F.col("lo"))
        m = m.select("sig", "m_tokens", F.when(shared, F.col("mid")).otherwise(F.col("lo")).alias("lo"),
                     F.when(shared, F.col("hi")).otherwise(F.col("mid") - 1).alias("hi"))
    h1, h2 = hashes(F.array_join(F.slice("m_tokens", 1, F.col("lo")), SEP))
    m = cut_lineage(m.filter(F.col("lo") > 0).select("sig", F.col("lo").alias("k"), h1.alias("h1"), h2.alias("h2")), "deepest")
    under = (tp.join(m.select("k", "h1", "h2").distinct(), ["k", "h1", "h2"], "left_semi").groupBy("k", "h1", "h2")
             .agg(F.array_sort(F.collect_set("template")).alias("relevant")))  # the result lists them
    return m.join(under, ["k", "h1", "h2"]).select("sig", F.col("k").alias("depth"), "relevant")
