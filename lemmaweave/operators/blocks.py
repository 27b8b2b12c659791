"""Evidence from page blocks of born-digital documents.

blocks: paper_id, source_ref, page, block_index, x0, y0, x1, y1, text.  Reading
order, headings, statements and bibliography are column expressions; a statement's
continuation looks at a bounded window of the blocks behind its heading.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalar

#: Heading words of statements (fixed values).
KINDS = "Theorem|Lemma|Proposition|Corollary|Definition|Claim|Conjecture|Example|Remark"
HEADING = rf"(?i)^({KINDS})\s+([A-Za-z]?(?:\d+(?:\.\d+)*|[A-Z])?)(.*)$"
PROOF = r"(?i)^Proof(?:\s*[.:]|\s*$|\s+of\b)"
#: Words that carry a statement on behind a full stop (fixed values).
CONTINUE_WORDS = ("Then", "Moreover", "Furthermore", "In particular", "where", "such that")


def in_order(blocks: DataFrame) -> DataFrame:
    """Adds position in reading order from 0, flat text and whether the bibliography has begun."""
    w = Window.partitionBy("paper_id").orderBy("page", F.round("y0", 1), F.round("x0", 1), "block_index")
    flat = scalar.collapsed(F.coalesce("text", F.lit("")))
    begins = F.lower(flat).isin("references", "bibliography")
    rows = blocks.withColumns({"flat": flat, "position": F.row_number().over(w) - 1})
    return rows.withColumn("back", F.coalesce(F.max(begins.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)) == 1, F.lit(False)))


def _heading(flat: Column, text: Column) -> Column:
    """A heading is explicit: punctuation behind the number, or nothing else on its first line."""
    rest = F.ltrim(F.regexp_extract(flat, HEADING, 3))
    first = scalar.collapsed(F.split(text, "\n").getItem(0))
    alone = first == F.concat_ws(" ", F.regexp_extract(flat, HEADING, 1), F.regexp_extract(flat, HEADING, 2))
    return flat.rlike(HEADING) & (rest.rlike(r"^[.:(]") | alone)


def _carries_on(flat: Column) -> Column:
    """A word that continues, as a whole word, or a number in brackets."""
    said = [flat.startswith(w) & ~F.substring(flat, len(w) + 1, 1).rlike(r"\w") for w in CONTINUE_WORDS]
    number = F.substring_index(F.substring(flat, 2, 1_000_000), ")", 1)
    out = flat.startswith("(") & flat.contains(")") & number.rlike("^[0-9]+$")
    for one in said:
        out = out | one
    return out


def _section(flat: Column) -> Column:
    """A number of parts joined by dots, then a word with a capital."""
    words = F.split(flat, " ")
    parts = F.split(F.regexp_replace(F.get(words, F.lit(0)), "[.]$", ""), "[.]")
    return F.forall(parts, lambda x: x.rlike("^[0-9]+$")) & F.coalesce(F.get(words, F.lit(1)).rlike("^[A-Z]"), F.lit(False))


def _nothing_said(rest: Column) -> Column:
    """Behind the number at most a title in brackets and one stop: the statement itself stands in the next block."""
    rest = F.trim(rest)
    behind = F.when(rest.startswith("("), F.when(rest.contains(")"), F.trim(F.substring(rest, F.locate(")", rest) + 1, F.length(rest))))).otherwise(rest)
    return F.coalesce(behind.isin("", ".", ":"), F.lit(False))


def statements(blocks: DataFrame, gap: float = 36.0, most: int = 7, longest: int = 12_000) -> DataFrame:
    """paper_id, local_id, kind, visible_number, statement, positions.

    Every heading sees the blocks behind it as an array; running heads fall out, each block is held against the one
    before, and the statement ends at the first that does not belong to it.
    """
    flat, number = F.col("flat"), F.regexp_extract("flat", HEADING, 2)
    capitals = (F.upper(flat) == flat) & (F.lower(flat) != flat)
    rows = in_order(blocks).where("not back").withColumn("b", F.struct(
        "position", "page", "x0", "x1", "y0", "y1", "flat", F.length(F.coalesce("text", F.lit(""))).alias("n"),
        ((F.col("block_index") == 0) & (capitals | (flat == F.col("page").cast("string")))).alias("running"),
        (flat.rlike(PROOF) | flat.rlike(HEADING) | _section(flat)).alias("stops"), _carries_on(flat).alias("more"), flat.rlike(r"[.!?]$").alias("ended"),
    ))
    order = Window.partitionBy("paper_id").orderBy("position")
    rows = rows.withColumn("behind", F.collect_list("b").over(order.rowsBetween(1, most))).where(_heading(flat, F.col("text")))
    rows = rows.withColumns({"chain": F.concat(F.array("b"), F.filter("behind", lambda x: ~x["running"])), "bare": _nothing_said(F.regexp_extract("flat", HEADING, 3))})

    def breaks(k: Column) -> Column:
        last, now = F.get("chain", k - 1), F.get("chain", k)
        away = (now["page"] == last["page"]) & ((now["y0"] - last["y1"] > gap) | (now["x0"] > last["x1"]) | (now["x1"] < last["x0"]))
        closed = ~(F.col("bare") & (k == 1)) & last["ended"] & ~now["more"]
        size = F.aggregate(F.slice("chain", F.lit(1), k + 1), F.lit(0), lambda total, x: total + x["n"])
        return F.coalesce((now["page"] > F.col("b.page") + 1) | now["stops"] | away | closed | (size > longest), F.lit(False))

    size = F.size("chain")
    cut = F.when(size > 1, F.array_position(F.transform(F.sequence(F.lit(1), size - 1), breaks), True)).otherwise(0).cast("int")
    taken = F.slice("chain", F.lit(1), F.when(cut > 0, cut).otherwise(size))
    rows = rows.select("paper_id", "position", F.lower(F.regexp_extract("flat", HEADING, 1)).alias("kind"), F.nullif(number, F.lit("")).alias("visible_number"), taken.alias("taken"), F.row_number().over(order).alias("_at"))
    rows = rows.withColumn("_base", F.concat(F.lit("pdf:"), "kind", F.lit(":"), F.lower(F.coalesce("visible_number", F.col("_at").cast("string")))))
    again = F.row_number().over(Window.partitionBy("paper_id", "_base").orderBy("position"))
    rows = rows.withColumn("local_id", F.when(again == 1, F.col("_base")).otherwise(F.concat("_base", F.lit(":"), again.cast("string"))))
    return rows.select("paper_id", "local_id", "kind", "visible_number", F.array_join(F.transform("taken", lambda x: x["flat"]), "\n").alias("statement"), F.transform("taken", lambda x: x["position"]).alias("positions"))


#: Kinds that a proof's heading names (fixed values), and arXiv identifiers as words.
GOAL_KINDS = ("theorem", "lemma", "proposition", "corollary", "claim")
ARXIV = r"^(?:[0-9]{4}[.][0-9]{4,5}|[a-z][a-z0-9.-]*/[0-9]{7})(?:v[1-9][0-9]*)?$"


def proofs(blocks: DataFrame, found: DataFrame) -> DataFrame:
    """paper_id, position, text (first line), owner, basis: a named single goal with one match, else the block right behind a statement."""
    rows = in_order(blocks).where("not back").withColumn("line", F.trim(F.split(F.ltrim("text"), "\n").getItem(0))).where(F.col("line").rlike(PROOF))
    rows = rows.withColumn("_w", F.split(F.regexp_replace("line", r"(?i)^proof\s+of\s+", ""), r"\s+")).withColumn("_of", F.col("line").rlike(r"(?i)^proof\s+of\s"))
    # the goal is one kind word, if any, and one number; the line ends there, or a stop or a bracket follows
    first = F.lower(F.get("_w", F.lit(0)))
    rows = rows.withColumn("_kind", F.when(first.isin(*GOAL_KINDS), first).otherwise("")).withColumn("_at", F.when(F.col("_kind") == "", 0).otherwise(1))
    token = F.get("_w", F.col("_at"))
    rest = F.array_join(F.slice("_w", F.col("_at") + 2, F.size("_w")), " ")
    bare = F.regexp_replace(token, r"[.:]$", "")
    closed = F.when(rest == "", True).when(rest.startswith("("), rest.rlike(r"^\([^)]*\)(?:[.:]|$)")).otherwise(token.rlike(r"[.:]$") & ~F.lower(F.split(rest, " ").getItem(0)).isin("and", "or"))
    single = F.col("_of") & bare.rlike(r"^[A-Za-z]?\d+(\.\d+)*$") & closed
    rows = rows.select("paper_id", "position", "line", F.when(single, F.col("_kind")).otherwise("").alias("g_kind"), F.when(single, F.lower(bare)).otherwise("").alias("g_number"), F.col("line").rlike(r"(?i)^proof\s*(?:[.:]|$)").alias("unnamed"))
    names = found.select(F.col("paper_id").alias("p"), "local_id", F.col("kind").alias("k"), F.lower("visible_number").alias("n"), F.array_max("positions").alias("end"))
    named = rows.where("g_number <> ''").join(names, (F.col("paper_id") == F.col("p")) & (F.col("g_number") == F.col("n")) & ((F.col("g_kind") == "") | (F.col("g_kind") == F.col("k"))))
    named = named.groupBy("paper_id", "position").agg(F.count("*").alias("c"), F.min("local_id").alias("named")).where("c = 1").drop("c")
    behind = names.select(F.col("p").alias("paper_id"), (F.col("end") + 1).alias("position"), F.col("local_id").alias("behind"))
    out = rows.join(named, ["paper_id", "position"], "left").join(behind, ["paper_id", "position"], "left")
    free = F.col("unnamed") & F.col("behind").isNotNull()
    return out.select("paper_id", "position", F.col("line").alias("text"), F.coalesce("named", F.when(free, F.col("behind"))).alias("owner"),
                      F.when(F.col("named").isNotNull(), "proof_heading_names_result").when(free, "immediately_follows_result").otherwise("unresolved").alias("basis"))


def bibliography(blocks: DataFrame) -> DataFrame:
    """paper_id, label, raw_text, arxiv_id, doi, url of bracketed entries behind the heading."""
    lines = in_order(blocks).where("back").select("paper_id", "position", F.posexplode_outer(F.split("text", r"\n(?=\s*\[[^\]\n]+\])")).alias("part", "entry"))
    raw = scalar.collapsed(F.col("entry"))
    # identifiers are words of their own: brackets, quotes and stops around them fall off
    words = F.transform(F.split(raw, r"[\s\[\](){}<>\",;]+"), lambda w: F.regexp_replace(w, r"[.:]+$", ""))
    names = F.transform(words, lambda w: F.regexp_replace(F.lower(w), "^arxiv:", ""))
    arxiv = F.get(F.filter(names, lambda w: w.rlike(ARXIV)), F.lit(0))
    tidy = lambda c: F.nullif(F.regexp_replace(c, r"[.,;)]+$", ""), F.lit(""))
    whole = F.split(raw, " ")
    web = F.get(F.filter(whole, lambda w: w.rlike("^https?://.")), F.lit(0))
    doi = F.get(F.filter(whole, lambda w: w.rlike("(?i)^(doi:|https://doi[.]org/).")), F.lit(0))
    doi = F.regexp_replace(doi, "(?i)^(doi:|https://doi[.]org/)", "")
    return lines.where(raw.rlike(r"^\[[^\]]+\]\s*\S")).select(
        "paper_id", "position", "part", F.regexp_extract(raw, r"^\[([^\]]+)\]", 1).alias("label"), raw.alias("raw_text"),
        F.regexp_replace(arxiv, "v[1-9][0-9]*$", "").alias("arxiv_id"), tidy(doi).alias("doi"), tidy(web).alias("url"))
