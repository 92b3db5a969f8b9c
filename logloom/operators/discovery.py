"""Template discovery: propose, clean, verify, add, match again.

The reference walks the lines one at a time with a growing template cache.
Here the unit of work is a distinct message signature and every round is a
set-at-a-time job:

1. match the pending signatures against the template table (C1);
2. the misses are grouped by the template the clean-up rules give them
   (G8); one representative per group (smallest line number) is proposed
   for - by a plug-in proposer (P1, e.g. a model) or by the rules alone
   (P2);
3. a proposal must match its own message (P3), else the rule template is
   used; too-general proposals give no template (B10, B11);
4. proposals join the template table (P4; the same token path replaces the
   older template), the representative takes its proposal directly, and the
   rest go to the next round.

With the rule proposer every signature whose template matches itself is
settled after two rounds; the rounds go on until no signature is pending.  The
pending table and the template table are checkpointed each round into the
shared checkpoint folder.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from functools import reduce
from itertools import combinations
from math import comb

import pandas as pd
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.functions.text import (ASSISTANT_ACK, DEFAULT_EXAMPLE_ANSWER, DEFAULT_EXAMPLE_QUERY, INSTRUCTION,
                                    SYSTEM_PROMPT, WILDCARD, clean_template, is_too_general, keyed_signature,
                                    match_pattern, parse_answer, propose_template, sig_tokens, words, render_example_answer, render_example_query)
from logloom.operators.matching import best_match, build_matcher
from logloom.session import cut_lineage, cut_observed, scratch_path

TEMPLATE_SCHEMA = "template_id long, template string"

Proposer = Callable[[pd.DataFrame], pd.Series]


def empty_templates(spark, group_col: str | None = None) -> DataFrame:
    schema = TEMPLATE_SCHEMA + (f", {group_col} string" if group_col else "")
    return spark.createDataFrame([], schema)


def signatures(lines: DataFrame, content_col: str = "Content", order_col: str = "LineId",
               group_col: str | None = None) -> DataFrame:
    """Distinct signatures with their first message (partial aggregation)."""
    G = [group_col] if group_col else []
    x = lines.select(*G, F.col(order_col).alias("_o"), F.col(content_col).alias("_c"))
    x = x.withColumn("sig", keyed_signature("_c", group_col))
    return x.groupBy(*G, "sig").agg(F.min("_o").alias("first_line"),
                                    F.min_by("_c", "_o").alias("rep_content"),
                                    F.count("*").alias("n_lines"))


def build_prompt(query_col, examples_col=None):
    """Chat messages (system, instruction, examples, question)."""
    head = [F.struct(F.lit("system").alias("role"), F.lit(SYSTEM_PROMPT).alias("content")),
            F.struct(F.lit("user").alias("role"), F.lit(INSTRUCTION).alias("content")),
            F.struct(F.lit("assistant").alias("role"), F.lit(ASSISTANT_ACK).alias("content"))]
    default = F.array(F.struct(F.lit(DEFAULT_EXAMPLE_QUERY).alias("query"),
                               F.lit(DEFAULT_EXAMPLE_ANSWER).alias("answer")))
    ex = default if examples_col is None else F.when(
        F.size(F.coalesce(examples_col, F.array())) > 0, examples_col).otherwise(default)
    pairs = F.flatten(F.transform(ex, lambda e: F.array(
        F.struct(F.lit("user").alias("role"), e["query"].alias("content")),
        F.struct(F.lit("assistant").alias("role"), e["answer"].alias("content")))))
    question = F.struct(F.lit("user").alias("role"),
                        F.concat(F.lit("Log message: `"), query_col, F.lit("`")).alias("content"))
    return F.concat(F.array(*head), pairs, F.array(question))


def build_completion_prompt(query_col, examples_col=None):
    """G23 plain-text form for completion models."""
    ex_text = F.lit("") if examples_col is None else F.concat(
        F.lit("Here are some examples:\n"),
        F.array_join(F.transform(examples_col, lambda e: F.concat(e["query"], F.lit("\n"), e["answer"])), "\n"),
        F.lit("\n"))
    return F.concat(F.lit(INSTRUCTION + "\n"), ex_text, F.lit("Please parse the following log message:\nLog message: `"),
                    query_col, F.lit("`\n"))


#: Prompts that a task asks at once, and so the most answers a lost executor can lose.
ASKED_AT_ONCE = 16


def _answer_files(folder: str, keys: list[str]) -> list[str | None]:
    """The stored answers of prompts, None where there is none."""
    fs, base = pafs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else "file://" + folder)
    found = fs.get_file_info([f"{base}/{k}" for k in keys])
    return [fs.open_input_stream(f.path).readall().decode() if f.type == pafs.FileType.File else None for f in found]


def _store_answer(folder: str, key: str, answer: str) -> None:
    """Store one answer under the hash of its prompt: a whole file or none."""
    fs, base = pafs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else "file://" + folder)
    fs.create_dir(base, recursive=True)
    part = f"{base}/.{key}-{uuid.uuid4().hex}"
    with fs.open_output_stream(part) as f:
        f.write(answer.encode())
    fs.move(part, f"{base}/{key}")


def answers(asked: DataFrame, proposer: Proposer, folder: str, attempts: int = 3) -> DataFrame:
    """(prompt, response) for the rows (prompt, rep_content, messages) of ``asked``, one for each prompt.

    ``prompt`` is the hash of the messages.  Every answer is stored in the shared ``folder`` under that
    hash as soon as it is there, a few prompts at a time, so a task that runs again, or a later job with
    the same folder, asks only what has no answer yet.  The answers that came are written as a table for
    each attempt; prompts whose answer failed (None) are asked again, ``attempts`` times in all, as those
    that are not in the tables so far."""
    def fn(it):
        for pdf in it:
            for lo in range(0, len(pdf), ASKED_AT_ONCE):
                part = pdf.iloc[lo:lo + ASKED_AT_ONCE].reset_index(drop=True)
                found = _answer_files(folder, list(part["prompt"]))
                new = [i for i, a in enumerate(found) if a is None]
                if new:
                    some = part.iloc[new]
                    out = proposer(pd.DataFrame({"content": list(some["rep_content"]), "messages": [json.loads(m) for m in some["messages"]]}))
                    for i, answer in zip(new, list(out)):
                        if answer is not None:
                            found[i] = answer
                            _store_answer(folder, part["prompt"][i], answer)
                yield pd.DataFrame({"prompt": part["prompt"], "response": pd.Series(found, dtype="object")})

    once = cut_lineage(asked.groupBy("prompt").agg(F.min_by(F.struct("rep_content", "messages"), "rep_content").alias("r")).select("prompt", "r.*"), "prompts")
    done, pending = None, once
    for _ in range(attempts):
        got, seen = cut_observed(pending.mapInPandas(fn, "prompt string, response string"), "answers", failed=F.count_if(F.col("response").isNull()))
        good = got.filter(F.col("response").isNotNull())
        done = good if done is None else done.unionByName(good)
        if not seen["failed"]:
            break
        pending = once.join(done.select("prompt"), "prompt", "left_anti")
    return done


def propose(reps: DataFrame, proposer: Proposer | None = None, examples: DataFrame | None = None,
            k: int = 3, group_col: str | None = None, selection_method: str = "jaccard", answers_dir: str | None = None) -> DataFrame:
    """P1-P3 for representatives (sig, rep_content, rule_template) -> proposal.

    ``answers_dir``: the shared folder of the model's answers (see ``answers``); by default one of
    this call's own, so that at least tasks which run again find them.

    ``selection_method``: how the k examples of a prompt are chosen, ``random`` (E12) or the name
    of the distance of the nearest ones (G12-G16)."""
    if proposer is None:
        return reps.withColumn("proposal", F.col("rule_template"))
    from logloom.operators.examples import nearest_examples, random_examples
    one_word = F.size(words("rep_content")) == 1
    ask = reps.filter(~one_word)
    if examples is not None:
        asked = ask.select("sig", F.col("rep_content").alias("query_text"))
        if selection_method == "random":
            near = random_examples(asked, examples, k, key_col="sig").groupBy("sig").agg(F.transform(
                F.array_sort(F.collect_list(F.struct("draw", "query", "answer"))),  # k rows
                lambda e: F.struct(render_example_query(e["query"]).alias("query"),
                                   render_example_answer(e["answer"]).alias("answer"))).alias("examples"))
        else:
            near = nearest_examples(asked, examples, k=k, method=selection_method, key_col="sig")
        ask = ask.join(near.select("sig", "examples"), "sig", "left")
    else:
        ask = ask.withColumn("examples", F.lit(None).cast("array<struct<query:string,answer:string>>"))
    ask = ask.withColumn("messages", build_prompt(F.col("rep_content"), F.col("examples")))
    ask = ask.select("sig", "rep_content", F.to_json("messages").alias("messages"))
    ask = cut_lineage(ask.withColumn("prompt", F.md5("messages")), "asked")
    answered = answers(ask, proposer, answers_dir or scratch_path(reps.sparkSession, "answer-files"))
    out = reps.join(ask.select("sig", "prompt").join(answered, "prompt").drop("prompt"), "sig", "left")
    answer_tpl = clean_template(parse_answer(F.col("response")))
    out = out.withColumn("_cand", F.when(one_word, clean_template(F.col("rep_content"))).otherwise(answer_tpl))
    ok = (F.col("_cand").isNotNull() & ~is_too_general(F.col("_cand"))
          & F.rlike(F.col("sig"), match_pattern(sig_tokens(keyed_signature(F.col("_cand"), group_col)))))
    return out.withColumn("proposal", F.when(ok, F.col("_cand")).otherwise(F.col("rule_template"))) \
        .drop("_cand", "response")


def _add_templates(T: DataFrame, new: DataFrame, group_col: str | None = None) -> DataFrame:
    """Append (template, first_line) rows; the same token path replaces
    the older template.

    New ids follow the largest existing id in order of first line (then token
    path): unique whatever the line numbers are, later than every existing id,
    and without a global window."""
    from logloom.session import ranked
    G = [group_col] if group_col else []
    new = new.withColumn("path", keyed_signature("template", group_col))
    new = new.groupBy(*G, "path").agg(F.min_by("template", "first_line").alias("template"),
                                      F.min("first_line").alias("first_line"))
    top = T.agg(F.max("template_id").alias("m")).first()["m"]
    new = ranked(new, ["first_line", "path"], "template_id", 0 if top is None else int(top) + 1)
    kept = T.withColumn("path", keyed_signature("template", group_col)).join(new.select("path"), "path", "left_anti")
    return kept.select("template_id", "template", *G).unionByName(new.select("template_id", "template", *G))


WINDOWS = (0.01, 0.1, 1.0)


def discover(lines: DataFrame, templates: DataFrame | None = None, proposer: Proposer | None = None,
             examples: DataFrame | None = None, k: int = 3,
             content_col: str = "Content", order_col: str = "LineId",
             stats: list | None = None, windows=WINDOWS, sigs_out: list | None = None,
             group_col: str | None = None, selection_method: str = "jaccard",
             answers_dir: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Give every distinct signature a template.

    Rounds work through the log in growing windows of first appearance
    (``windows`` = shares of the line-number range): in a round only the
    misses whose first line lies inside the window propose templates, while
    every pending signature is matched against everything found so far.  So
    templates found early settle the later lines by matching, as in a
    sequential pass, and the clean-up rules run on few signatures.

    Returns ``(assigned, templates)`` where ``assigned`` has ``sig``,
    ``template_id``, ``template`` (NULL when the message only yields a
    too-general template) and ``templates`` is the final template table.
    ``stats`` (a list) receives one dict per round (D26: proposals made).  All counts are
    observed while the round's tables are written; no job counts.
    """
    spark = lines.sparkSession
    G = [group_col] if group_col else []
    if templates is not None:
        T, seen = cut_observed(templates.select("template_id", "template", *G), "templates", n=F.count(F.lit(1)))
        n_templates = seen["n"]
    else:
        T, n_templates = empty_templates(spark, group_col), 0
    pending, span = cut_observed(signatures(lines, content_col, order_col, group_col), "sigs", n=F.count(F.lit(1)),
                                 lo=F.min("first_line"), hi=F.max("first_line"))
    if sigs_out is not None:
        sigs_out.append(pending)
    n_pending = span["n"]
    lo, hi = (span["lo"] or 0), (span["hi"] or 0)
    done: list[DataFrame] = []
    rnd = -1
    while True:  # a round with misses settles at least its representatives
        rnd += 1
        share = windows[min(rnd, len(windows) - 1)]
        bound = lo + int((hi - lo + 1) * share)
        if n_templates == 0:
            miss, n_miss = pending, n_pending
        else:
            matcher = build_matcher(T, group_col=group_col)
            mm = matcher.apply(pending, sig_col="sig") if matcher is not None else None  # map-side: pending not shuffled
            m, seen = cut_observed(mm if mm is not None else best_match(pending, T, group_col=group_col), "matched",
                                   missed=F.count_if(F.col("template_id").isNull()))
            n_miss = seen["missed"]
            done.append(m.filter(F.col("template_id").isNotNull()).select("sig", "template_id", "template",
                                                                          F.lit("match").alias("source")))
            miss = m.filter(F.col("template_id").isNull()).drop("template_id", "template")
        if n_miss == 0:
            if sigs_out is not None and n_templates > 0:
                sigs_out.append(matcher)   # T unchanged since: the caller may reuse it
            break
        if share < 1.0:
            later = miss.filter(F.col("first_line") > bound)
            miss = miss.filter(F.col("first_line") <= bound)
        else:
            later = None
        live = cut_lineage(miss.withColumn("rule_template", propose_template(F.col("rep_content")))
                           .withColumn("key", keyed_signature("rule_template", group_col)), "live")
        done.append(live.filter(F.col("rule_template").isNull()).select(
            "sig", F.lit(None).cast("long").alias("template_id"), F.lit(None).cast("string").alias("template"),
            F.lit("general").alias("source")))
        live = live.filter(F.col("rule_template").isNotNull())
        reps = live.groupBy("key").agg(F.min_by(F.struct("sig", *G, "rep_content", "rule_template", "first_line"),
                                                "first_line").alias("r")).select("r.*")
        reps, proposed = cut_observed(propose(reps, proposer, examples, k, group_col, selection_method, answers_dir)
                                      .withColumn("path", keyed_signature("proposal", group_col)), "proposals", n=F.count(F.lit(1)))
        T, seen = cut_observed(_add_templates(T, reps.select(F.col("proposal").alias("template"), "first_line", *G), group_col),
                               "templates", n=F.count(F.lit(1)))
        n_templates = seen["n"]
        ids = T.withColumn("path", keyed_signature("template", group_col)).select("path", "template_id")
        done.append(reps.join(ids, "path", "left")  # both are written tables: their sizes decide the join
                    .select("sig", "template_id", F.col("proposal").alias("template"), F.lit("proposal").alias("source")))
        if stats is not None:
            stats.append({"round": rnd + 1, "window": share, "misses": n_miss, "proposals": proposed["n"]})
        keep = ["sig", *G, "first_line", "rep_content", "n_lines"]
        rest = live.join(reps.select("sig"), "sig", "left_anti").select(*keep)
        if later is not None:
            rest = rest.unionByName(later.select(*keep))
        pending, seen = cut_observed(rest, "pending", n=F.count(F.lit(1)))
        n_pending = seen["n"]
    if not done:  # no line at all
        return pending.select("sig", F.lit(None).cast("long").alias("template_id"), F.lit(None).cast("string").alias("template"),
                              F.lit("general").alias("source")), T
    assigned = done[0]
    for d in done[1:]:
        assigned = assigned.unionByName(d)
    return assigned, T


def parse(lines: DataFrame, templates: DataFrame | None = None, proposer: Proposer | None = None,
          examples: DataFrame | None = None, k: int = 3,
          content_col: str = "Content", order_col: str = "LineId",
          group_col: str | None = None, selection_method: str = "jaccard",
          stats: list | None = None, answers_dir: str | None = None,
          known_ids: DataFrame | None = None, ids_out: list | None = None) -> tuple[DataFrame, DataFrame]:
    """Structured log: every line with EventTemplate and EventId.

    ``group_col`` (e.g. ``dataset``) parses many systems in one job: the
    dataset is a leading token of every signature and template, so templates
    and ids are per dataset.

    After discovery every line takes the most specific template of the final
    table (map-side match, no shuffle of the lines); a representative keeps
    the template it proposed (a broadcast table with one row per proposal).
    Since a line's template depends only on its signature, the E1 ids (order
    of first appearance) come from the distinct-signature table and reach the
    lines through a broadcast join on the template.  When the template table
    is too large for the map-side match, the distinct signatures are ranked
    against the same final table by a join and joined back: the result is the
    same.

    ``stats`` (a list) receives the proposals of each round (D26).  ``known_ids``
    (EventTemplate, number) are the numbers that templates already have; new ones
    follow the largest.  ``ids_out`` (a list) receives the table of new numbers.
    Returns ``(structured, templates)``."""
    from logloom.operators.matching import build_matcher, event_numbers
    sigs_out: list = []
    G = [group_col] if group_col else []
    assigned, T = discover(lines, templates, proposer, examples, k, content_col=content_col, order_col=order_col,
                           sigs_out=sigs_out, group_col=group_col, selection_method=selection_method, stats=stats, answers_dir=answers_dir)
    reused = sigs_out[1] if len(sigs_out) > 1 else None
    matcher = reused if reused is not None else build_matcher(T, group_col=group_col)
    # proposals are rows of the written per-round tables: counting them is a metadata-sized read
    props = assigned.filter(F.col("source") == "proposal").select("sig", F.col("template").alias("_prop"))
    props = F.broadcast(props) if props.count() <= 2_000_000 else props

    def final(df):
        return (df.join(props, "sig", "left")
                .withColumn("EventTemplate", F.when(F.col("_prop").isNotNull(), F.col("_prop")).otherwise(F.col("template")))
                .drop("_prop", "template", "template_id"))
    sigs = sigs_out[0].select("sig", *G, "first_line")
    if matcher is not None:
        out = final(matcher.apply(lines, content_col)).drop("sig")
        per_sig = final(matcher.apply(sigs, sig_col="sig"))
    else:  # the same ranking against the final table, as a join of the distinct signatures
        per_sig = cut_lineage(final(best_match(sigs, T, group_col=group_col)).select("sig", *G, "first_line", "EventTemplate"), "final")
        out = lines.withColumn("sig", keyed_signature(content_col, group_col)).join(per_sig.select("sig", "EventTemplate"), "sig", "left").drop("sig")
    firsts = per_sig.filter(F.col("EventTemplate").isNotNull()).groupBy(*G, "EventTemplate").agg(
        F.min("first_line").alias("_first"))
    new = event_numbers(firsts, "EventTemplate", G, known_ids)
    if ids_out is not None:
        ids_out.append(new)
    ids = new if known_ids is None else new.unionByName(known_ids.select(*G, "EventTemplate", "number"))
    ids = ids.select(*G, "EventTemplate", F.concat(F.lit("E"), F.col("number").cast("string")).alias("EventId"))
    ids = F.broadcast(ids) if matcher is not None else ids  # one row per template: the matcher's size check bounds it
    return out.join(ids, [*G, "EventTemplate"], "left"), T


#: The most ways of leaving words out of a template for which ``merge_similar`` goes by the shortened templates.
VARIANTS = 256


def _most_deleted(n: int, threshold: float) -> int:
    """The most words that a template of n words may lack of a near duplicate (-1: it has none)."""
    return max((d for d in range(n) if (n - d) / n > threshold), default=-1)


def _by_deletion(t: DataFrame, sizes: list[int], threshold: float) -> DataFrame:
    """Most similar older templates ``new_id, old_id, sim`` of short templates (template_id, w, nw, w0).

    Templates of n words share n - d of them in order exactly when leaving out d words of each can give the same
    words.  So for d = 0, 1, .. each template's shortened forms (as 128-bit hashes) meet the oldest id that has them;
    a template that finds an older one needs no larger d, and its own forms stay for the others."""
    found, open_ = [], t
    for d in range(max(_most_deleted(n, threshold) for n in sizes) + 1):
        def forms(rows):
            parts = []
            for n in [n for n in sizes if _most_deleted(n, threshold) >= d]:
                keeps = F.array(*[F.array(*[F.lit(i) for i in keep]).cast("array<int>") for keep in combinations(range(n), n - d)])
                parts.append(rows.filter(F.col("nw") == n).select("template_id", "nw", "w0", "w", F.explode(keeps).alias("keep")))
            f = reduce(DataFrame.unionByName, parts)
            form = F.array_join(F.transform("keep", lambda i: F.get("w", i)), " ")
            return f.select("template_id", "nw", "w0", F.xxhash64(form).alias("h1"), F.xxhash64(F.lit("second"), form).alias("h2"))
        key = ["nw", "w0", "h1", "h2"]
        oldest = forms(t).groupBy(*key).agg(F.min("template_id").alias("old_id"), F.max("template_id").alias("_last"))
        oldest = oldest.filter(F.col("old_id") < F.col("_last")).drop("_last")  # forms of one template alone find nothing
        met = forms(open_).join(oldest, key).filter(F.col("old_id") < F.col("template_id"))
        near = cut_lineage(met.groupBy(F.col("template_id").alias("new_id"), "nw").agg(F.min("old_id").alias("old_id")), "merge-near")
        found.append(near.select("new_id", "old_id", ((F.col("nw") - d) / F.col("nw")).alias("sim")))
        open_ = open_.join(near.select(F.col("new_id").alias("template_id"), "nw"), ["template_id", "nw"], "left_anti")
    schema = t.schema["template_id"].dataType.simpleString()
    return reduce(DataFrame.unionByName, found) if found else t.sparkSession.createDataFrame([], f"new_id {schema}, old_id {schema}, sim double")


def _by_prefix(t: DataFrame, threshold: float) -> DataFrame:
    """Near duplicates ``new_id, old_id, sim`` of templates (template_id, w, nw, w0) by an exact prefix filter.

    LCS >= t implies the two word multisets share at least t elements (an element is a word and its occurrence
    number), so they share one of their first ``n - t + 1`` elements in any fixed order; the order is by rarity over
    all these templates, so the elements that meet are rare.  The bit masks of the LCS are made once for each
    template."""
    from logloom.functions.distance import lcs_masks, lcs_similarity
    from logloom.session import ranked
    words_of = t.select("template_id", "nw", "w0", F.explode("w").alias("word")).groupBy("template_id", "nw", "w0", "word").agg(F.count("*").alias("c"))
    occ = words_of.select("template_id", "nw", "w0", F.explode(F.transform(F.sequence(F.lit(1).cast("long"), "c"),
                          lambda i: F.concat_ws("\x1f", "word", i.cast("string")))).alias("elem"))
    occ = cut_lineage(occ, "merge-elements")
    ranks = ranked(occ.groupBy("elem").agg(F.count("*").alias("df")), ["df", "elem"], "r").select("elem", "r")
    need = F.floor(F.col("nw") * threshold).cast("int") + 1        # LCS must reach this
    pref = occ.join(ranks, "elem").groupBy("template_id", "nw", "w0").agg(F.array_sort(F.collect_list("r")).alias("es"))  # words of one template
    pref = pref.select("template_id", "nw", "w0", F.explode(F.slice("es", 1, F.greatest(F.col("nw") - need + 1, F.lit(1)))).alias("r"))
    pref = cut_lineage(pref, "merge-prefixes")
    a, b = pref.alias("a"), pref.alias("b")
    cand = (a.join(b, (F.col("a.nw") == F.col("b.nw")) & (F.col("a.w0") == F.col("b.w0"))
                   & (F.col("a.r") == F.col("b.r")) & (F.col("a.template_id") < F.col("b.template_id")))
            .select(F.col("a.template_id").alias("old_id"), F.col("b.template_id").alias("new_id")).distinct())
    tw = cut_lineage(t.select("template_id", "w", lcs_masks("w").alias("masks")), "merge-masks")
    cand = (cand.join(tw.select(F.col("template_id").alias("old_id"), F.col("w").alias("old_w")), "old_id")
            .join(tw.withColumnsRenamed({"template_id": "new_id", "w": "new_w"}), "new_id"))
    return cand.withColumn("sim", lcs_similarity("old_w", "new_w", "masks")).filter(F.col("sim") > threshold).select("new_id", "old_id", "sim")


def merge_similar(templates: DataFrame, threshold: float = 0.8) -> DataFrame:
    """P5: merge near-duplicate templates (off by default, as in the reference).

    Two templates are near duplicates when they have the same number of
    words, the same first word, and word-LCS similarity ``2*LCS/(m+n)`` above
    ``threshold`` (G11).  No pairs of a block are made where at most ``VARIANTS`` ways
    lead to the fewest words that a pair must share (``_by_deletion``); longer templates
    meet in rare words (``_by_prefix``).  Every
    template joins its most similar older template (ties: older id); an older
    template absorbs all that join it, position by position (words that
    differ become ``<*>``, G25), and keeps its id.

    Returns ``template_id, template, merged_from`` (ids absorbed)."""
    t = templates.select("template_id", "template").withColumn("w", F.split(F.col("template"), " "))
    t = cut_lineage(t.withColumn("nw", F.size("w")).withColumn("w0", F.col("w")[0]), "merge-templates")
    sizes = sorted(r["nw"] for r in t.filter(F.col("w").isNotNull()).select("nw").distinct().collect())  # word counts
    short = [n for n in sizes if sum(comb(n, d) for d in range(_most_deleted(n, threshold) + 1)) <= VARIANTS]
    found = [_by_deletion(t.filter(F.col("nw").isin(short)), short, threshold)] if short else []
    if len(short) < len(sizes) or not short:
        found.append(_by_prefix(t.filter(~F.col("nw").isin(short)), threshold))
    cand = reduce(DataFrame.unionByName, found)
    best = cut_lineage(cand.groupBy("new_id").agg(F.max_by("old_id", F.struct("sim", -F.col("old_id"))).alias("old_id")), "merge-best")
    members = best.join(t.select(F.col("template_id").alias("new_id"), "w"), "new_id")
    # of the words at one place only whether they are all the same matters: no group is gathered
    places = members.select("old_id", "new_id", F.posexplode("w").alias("i", "word")).groupBy("old_id", "i").agg(F.min("word").alias("lo"), F.max("word").alias("hi"))
    absorbed = places.groupBy("old_id").agg(F.array_sort(F.collect_list(F.struct("i", "lo", "hi"))).alias("at"))  # a row a word
    absorbed = absorbed.join(members.groupBy("old_id").agg(F.sort_array(F.collect_list("new_id")).alias("merged_from")), "old_id")
    kept = t.join(best.select(F.col("new_id").alias("template_id")), "template_id", "left_anti")
    out = kept.join(absorbed.withColumnRenamed("old_id", "template_id"), "template_id", "left")
    merged = F.when(F.col("at").isNull(), F.col("w")).otherwise(F.zip_with(
        "w", "at", lambda p, x: F.when((x["lo"] == p) & (x["hi"] == p), p).otherwise(F.lit(WILDCARD))))
    return out.select("template_id", F.array_join(merged, " ").alias("template"),
                      F.coalesce("merged_from", F.array().cast("array<long>")).alias("merged_from"))
