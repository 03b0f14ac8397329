"""Line deduplication by a fixed-depth template tree.

A line goes down the tree by its token count and its first DEPTH tokens, with digits generalised to
``<*>``.  In a leaf the most frequent template is the first seed; templates that equal it in SIMILAR % of
their tokens, position by position, belong to its group, the other positions being its variable fields.
Those left over choose further seeds among themselves until each has its group.  A group found in several
documents recurs: the first document (smallest doc_id) keeps its lines, all others lose them.

Only DataFrame functions.  A line travels as about 50 bytes whatever its length, and its tokens only if
its leaf has several templates, once for each template; texts are shuffled once, to meet the line numbers
that they lose.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayframe.llm.common import let, settle

DEPTH, SIMILAR = 3, 80
#: A group of lines with this many tokens that hold no digit recurs from two documents on.
LONG, LONG_DOCS = 8, 2
#: Shorter ones, down to this many tokens, meet by chance and need more documents; still shorter ones stay.
SHORT, SHORT_DOCS = 3, 20

#: White space inside a line, but for single spaces.
ODD_SPACE = r"(?:[\x09\x0B-\x0D]|\x20(?=[\x20\x09\x0B-\x0D]))[\x20\x09\x0B-\x0D]*"

DOC = ("no_id", "id", "th")
#: Bits of the filter for lines whose tokens are wanted, and bits in a word of it.
BITS, WORD = 1 << 22, 64
#: Templates' stretches left over, and tokens of them, up to which the driver goes through the remaining rounds by the same rule.
FEW, FEW_TOKENS = 5000, 1 << 20


def digest(text: Column) -> Column:
    """60 bits of the MD5 as a number, by which ties are broken."""
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")


def plain(text: Column) -> Column:
    """A text with digits generalised and single spaces between the words of a line; a line's ends may keep one."""
    return F.regexp_replace(F.regexp_replace(text, "[0-9]+", "<*>"), ODD_SPACE, " ")


def place(line: Column) -> list[Column]:
    """A plain line's place in the tree: n tokens, those of them without a digit, leaf, and template digest.  No array is built."""
    n = F.length(line) - F.length(F.replace(line, F.lit(" "), F.lit(""))) + 1
    digits = F.when(F.contains(line, F.lit("<*>")), F.regexp_count(line, F.lit(r"<\*>[^ ]*"))).otherwise(F.lit(0))
    return [n.alias("n"), (n - digits).alias("fixed"), F.xxhash64(n, F.substring_index(line, " ", DEPTH)).alias("leaf"), digest(line).alias("tpl")]


def keyed(docs: DataFrame) -> DataFrame:
    """Documents with the columns of DOC, by which they are ordered: null doc_ids last, ties by text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").isNull().alias("no_id"), F.coalesce("doc_id", F.lit(0)).cast("bigint").alias("id"), digest(text).alias("th"))


def cut(rows: DataFrame) -> DataFrame:
    """One row per line of keyed documents that has a word: its document, number, and plain text, made for the whole text at once."""
    x = rows.select(*DOC, F.posexplode(F.split(plain(F.coalesce("row.text", F.lit(""))), "\n")).alias("pos", "line"))
    return x.select(*DOC, "pos", F.trim("line").alias("line")).where("line <> ''")


def lines_of(docs: DataFrame) -> DataFrame:
    """One row per line that has a word: its document, number, and place in the tree."""
    return cut(keyed(docs)).select(*DOC, "pos", *place(F.col("line")))


def maybe_in(rows: DataFrame, wanted: DataFrame, *names: str) -> DataFrame:
    """The rows whose columns ``names`` may occur in ``wanted`` (with _ before its names), by a map of BITS bits: few others stay."""
    bit = lambda *c: F.pmod(F.xxhash64(*c), F.lit(BITS))
    bits = wanted.select(bit(*[f"_{c}" for c in names]).alias("bit")).distinct()
    bits = bits.groupBy(F.floor(F.col("bit") / WORD).alias("_word")).agg(F.bit_or(F.expr(f"shiftleft(1L, int(bit % {WORD}))")).alias("set"))
    near = rows.withColumn("bit", bit(*names)).join(F.broadcast(bits), F.floor(F.col("bit") / WORD) == F.col("_word"))
    return near.where(F.expr(f"shiftrightunsigned(set, int(bit % {WORD})) & 1L = 1L")).select(*rows.columns)


def with_tokens(templates: DataFrame, docs: DataFrame) -> DataFrame:
    """Rows (leaf, tpl, docs, tokens) of templates, the tokens cut from the line ``at`` that holds them.

    Documents are filtered before they are cut and lines before they are placed, so few others are cut or travel.
    """
    spots = templates.select("leaf", "tpl", "docs", *[F.col(f"at.{c}").alias(f"_{c}") for c in (*DOC, "pos")])
    near = maybe_in(cut(maybe_in(keyed(docs), spots, *DOC)), spots, *DOC, "pos")
    found = near.join(spots, [F.col(c) == F.col(f"_{c}") for c in (*DOC, "pos")])
    return found.dropDuplicates(["leaf", "tpl"]).select("leaf", "tpl", "docs", F.split("line", " ").alias("tokens"))


def alike(a: str, b: str) -> Column:
    """Whether two templates of a leaf are equal in SIMILAR % of their tokens."""
    equal = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda e: e))
    return 100 * equal >= SIMILAR * F.size(a)


def stretches(tokens: Column) -> Column:
    """Hashes of the stretches of a template after its leading tokens, one more than tokens may differ: templates that are alike share one."""

    def of(t: Column) -> Column:
        m, parts = F.size(t) - DEPTH, F.floor(F.size(t) * (100 - SIMILAR) / 100).cast("int") + 1

        def stretch(j: Column) -> Column:
            lo, hi = F.floor(j * m / parts).cast("int"), F.floor((j + 1) * m / parts).cast("int")
            return F.xxhash64(j, F.array_join(F.slice(t, lo + DEPTH + 1, hi - lo), " "))

        return F.transform(F.sequence(F.lit(0), parts - 1), stretch)

    return let(tokens, of)


def crowded(x: DataFrame) -> DataFrame:
    """The rows whose stretch is held by several templates of their leaf."""
    many = x.groupBy("leaf", "part").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("leaf", "part")
    return x.join(many, ["leaf", "part"], "left_semi")


def rounds(rows: list) -> list[tuple]:
    """The rounds of members() over collected rows (leaf, tpl, docs, part, tokens): (leaf, tpl, grp) of those that join a seed."""
    parts, tokens, rank, out = {}, {}, {}, []
    for r in rows:
        key = (r["leaf"], r["tpl"])
        parts.setdefault(key, set()).add((r["leaf"], r["part"]))
        tokens[key], rank[key] = r["tokens"], (r["docs"], -r["tpl"])
    while parts:
        head = {}
        for key in sorted(parts, key=rank.get):
            head |= dict.fromkeys(parts[key], key)
        seeds = {key for key, of in parts.items() if all(head[p] == key for p in of)}
        gone = set(seeds)
        for key, of in parts.items():
            a = tokens[key]
            like = [s for s in {head[p] for p in of} & seeds if s != key and 100 * sum(x == y for x, y in zip(a, tokens[s])) >= SIMILAR * len(a)]
            if like:
                out.append((*key, max(like, key=rank.get)[1]))
                gone.add(key)
        parts = {key: of for key, of in parts.items() if key not in gone}
    return out


def members(tokens: DataFrame) -> DataFrame | None:
    """Rows (leaf, tpl, grp) of the templates in groups of several, grp being the seed's template; None if there are none.

    In each round a template that no other one left exceeds (by documents, then digest) in any of its stretches is
    a seed, as all that are alike to it share a stretch with it; those that are alike join the greatest such seed.
    Seeds and members leave, until no two templates left share a stretch.  Each template is compared with the
    heads of its stretches only, so a round is linear, and the greatest template of a leaf leaves in each.
    """
    left = settle(crowded(tokens.select("leaf", "tpl", "docs", F.explode(stretches(F.col("tokens"))).alias("part"))), "stretches")
    all_joined = None
    while not left.isEmpty():
        rest = left.join(tokens.select("leaf", "tpl", "tokens"), ["leaf", "tpl"])
        if left.count() <= FEW and rest.agg(F.sum(F.size("tokens"))).first()[0] <= FEW_TOKENS:
            rest = rounds(rest.collect())
            if rest:
                joined = tokens.sparkSession.createDataFrame(rest, "leaf bigint, tpl bigint, grp bigint")
                all_joined = joined if all_joined is None else all_joined.union(joined)
            break
        rank = F.struct("docs", (-F.col("tpl")).alias("by"), F.col("tpl").alias("tpl"))
        heads = left.groupBy("leaf", "part").agg(F.max(rank).alias("head"))
        seen = settle(left.join(heads, ["leaf", "part"]).groupBy("leaf", "tpl", "head").agg(F.count(F.lit(1)).alias("_n")).drop("_n"), "seen")
        seeds = seen.groupBy("leaf", "tpl").agg(F.min(F.col("head.tpl") == F.col("tpl")).alias("is_seed")).where("is_seed").select("leaf", "tpl")
        pairs = seen.where("head.tpl <> tpl").withColumn("of", F.col("head.tpl")).join(seeds.withColumnRenamed("tpl", "of"), ["leaf", "of"], "left_semi")
        pairs = pairs.join(tokens.select("leaf", F.col("tpl").alias("of"), F.col("tokens").alias("theirs")), ["leaf", "of"])
        pairs = pairs.join(tokens.select("leaf", "tpl", "tokens"), ["leaf", "tpl"]).where(alike("tokens", "theirs"))
        joined = settle(pairs.groupBy("leaf", "tpl").agg(F.max("head").alias("head")).select("leaf", "tpl", F.col("head.tpl").alias("grp")), "joined")
        all_joined = joined if all_joined is None else all_joined.union(joined)
        left = settle(crowded(left.join(seeds.union(joined.select("leaf", "tpl")), ["leaf", "tpl"], "left_anti")), "stretches")
    return all_joined and all_joined.union(all_joined.select("leaf", F.col("grp").alias("tpl"), "grp").distinct())


def recurring(lines: DataFrame, docs: DataFrame) -> DataFrame:
    """The templates of groups that recur: (leaf, tpl, first), first being the document that keeps its lines."""
    once = lines.groupBy("n", "fixed", "leaf", "tpl", *DOC).agg(F.min("pos").alias("pos"))
    templates = once.groupBy("n", "fixed", "leaf", "tpl").agg(F.count(F.lit(1)).alias("docs"), F.min(F.struct(*DOC, "pos")).alias("at"), F.max(F.struct(*DOC)).alias("last"))
    templates = settle(templates.where(f"fixed >= {SHORT}"), "templates")
    several = templates.groupBy("leaf").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("leaf")
    # Templates with fewer tokens may not differ in any.
    contested = settle(templates.where(f"n * {100 - SIMILAR} >= 100").join(several, "leaf", "left_semi").select("leaf", "tpl", "docs", "at"), "contested")
    grouped = members(settle(with_tokens(contested, docs), "tokens"))
    t = templates.select("fixed", "leaf", "tpl", "docs", F.struct(*[F.col(f"at.{c}").alias(c) for c in DOC]).alias("first"), "last")
    if grouped is None:
        t = t.withColumn("grp", F.col("tpl")).where(f"docs >= {LONG_DOCS}")
    else:
        t = t.join(grouped, ["leaf", "tpl"], "left").where(f"grp IS NOT NULL OR docs >= {LONG_DOCS}").withColumn("grp", F.coalesce("grp", "tpl"))
    groups = t.groupBy("leaf", "grp").agg(F.min("fixed").alias("fixed"), F.sum("docs").alias("docs"), F.min("first").alias("first"), F.max("last").alias("last"))
    groups = groups.where(f"first <> last AND ((fixed >= {LONG} AND docs >= {LONG_DOCS}) OR docs >= {SHORT_DOCS})")
    return t.select("leaf", "tpl", "grp").join(groups.select("leaf", "grp", "first"), ["leaf", "grp"]).select("leaf", "tpl", "first")


def cleaned(docs: DataFrame) -> DataFrame:
    """Rows (row, new, n_lines, n_dropped): a document, its text less the recurring lines, and its lines with a word."""
    lines = settle(lines_of(docs), "lines")
    bad = recurring(lines, docs).withColumnsRenamed({"leaf": "_leaf", "tpl": "_tpl"})
    hit = lines.join(bad, (F.col("leaf") == F.col("_leaf")) & (F.col("tpl") == F.col("_tpl"))).where(F.struct(*DOC) != F.col("first"))
    lost = hit.groupBy(*DOC).agg(F.collect_set("pos").alias("lost")).withColumnsRenamed({c: f"_{c}" for c in DOC})
    j = keyed(docs).join(lost, [F.col(c) == F.col(f"_{c}") for c in DOC], "left")
    whole = F.coalesce("row.text", F.lit(""))
    stay = lambda x: F.array_except(F.sequence(F.lit(0), F.size(x) - 1), F.col("lost"))
    rest = let(F.split(whole, "\n"), lambda x: F.array_join(F.transform(stay(x), lambda i: F.get(x, i)), "\n"))
    n_lines = F.regexp_count(whole, F.lit(r"[^\x20\x09-\x0D][^\n]*")).cast("bigint")
    n_dropped = F.when(F.col("lost").isNull(), F.lit(0)).otherwise(F.size("lost")).cast("bigint")
    return j.select("row", F.when(F.col("lost").isNull(), F.col("row.text")).otherwise(rest).alias("new"), n_lines.alias("n_lines"), n_dropped.alias("n_dropped"))


def _columns(docs: DataFrame) -> list[Column]:
    def column(name: str, kind) -> Column:
        old = F.col("row").getField(name)
        if name == "text":
            return F.col("new")
        return F.when(F.col("n_dropped") > 0, F.length("new")).otherwise(old).cast(kind) if name == "n_chars" else old

    return [column(f.name, f.dataType).alias(f.name) for f in docs.schema.fields]


def drop_lines(docs: DataFrame) -> DataFrame:
    """Every row of documents with its text less the recurring lines, and n_lines and n_dropped (lines with a word).

    A null text stays null with no lines; texts and lines may be of any length; n_chars, where there is such a column, is set to the new length.
    Lines are cut at ``\\n`` only and joined again by it.  Rows that agree in doc_id and text are one
    document and stay alike.  Documents with the same doc_id and other texts are different documents.
    Other columns pass through, whatever they are called.  An empty table gives an empty result.
    """
    return cleaned(docs).select(*_columns(docs), *[c for c in ("n_lines", "n_dropped") if c not in docs.columns])


def keep_rest(docs: DataFrame) -> DataFrame:
    """drop_lines() with the columns of documents only, and without documents that have lost every line.

    Documents without a line (null, empty) stay; ties, repeated rows, clashing names and empty tables are as in drop_lines().
    """
    return cleaned(docs).where("n_dropped = 0 OR n_dropped < n_lines").select(*_columns(docs))

