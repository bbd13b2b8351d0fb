"""Gene loss: mutations, intactness of reading frames, classes and their roll-up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Classes in order of rank, from the rank -1, and the colours of annotation tracks.
RANKS = {"N": -1, "PG": 0, "PM": 1, "M": 2, "L": 3, "UL": 4, "PI": 5, "I": 6}
COLOURS = {"N": "0,0,0", "PG": "159,129,112", "PM": "169,169,169", "M": "130,130,130", "L": "255,50,50", "UL": "255,160,120", "PI": "0,200,255", "I": "0,0,200"}


def rank_of(label: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in RANKS.items() for x in pair])
    return F.try_element_at(table, label)


def label_of(rank: Column) -> Column:
    table = F.create_map(*[F.lit(x) for label, rank_ in RANKS.items() for x in (rank_, label)])
    return F.try_element_at(table, rank.cast("int"))


def colour_of(label: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in COLOURS.items() for x in pair])
    return F.coalesce(F.try_element_at(table, label), F.lit(COLOURS["N"]))


def intact_features(df: DataFrame, states: str = "states", middle_only: bool = False) -> DataFrame:
    """Five features of a reading frame from a letter per codon: I intact, D deleted, L lost, M missing.

    Longest stretch without L over all codons, deleted ones taken out, with
    missing codons taken out or counted as intact; intact codons among those not
    missing (1 if all are); no L in the first 90 % (or, ``middle_only``, in the
    middle 80 %); no M in the middle 80 %. A tenth is floor(codons / 10), and of
    fewer than ten codons the parts are empty, so both flags hold.
    """
    s = F.col(states)
    n = F.length(s)
    tenth = F.floor(n / 10).cast("int")
    middle = F.when(tenth > 0, F.substring(s, tenth + 1, n - 2 * tenth)).otherwise("")
    front = F.when(tenth > 0, F.substring(s, F.lit(1), n - tenth)).otherwise("")
    kept = F.regexp_replace(s, "D", "")

    def longest(text: Column) -> Column:
        return F.array_max(F.transform(F.split(text, "L"), lambda x: F.length(x)))

    shown = n - F.length(F.regexp_replace(s, "[^M]", ""))
    intact = F.length(F.regexp_replace(s, "[^I]", ""))
    broken = middle if middle_only else front
    return df.withColumns(
        {
            "intact_ignore_m": F.coalesce(F.try_divide(longest(F.regexp_replace(kept, "M", "")), n), F.lit(1.0)),
            "intact_intact_m": F.coalesce(F.try_divide(longest(F.regexp_replace(kept, "M", "I")), n), F.lit(1.0)),
            "intact_codons": F.coalesce(F.try_divide(intact, shown), F.lit(1.0)),
            "middle_is_intact": ~F.contains(broken, F.lit("L")),
            "middle_is_present": ~F.contains(middle, F.lit("M")),
        }
    )


def needed_exons(exons: Column) -> Column:
    """Affected exons that make a loss: 1 of 1, 2 of up to 10, else a fifth."""
    return F.when(exons == 1, 1.0).when(exons <= 10, 2.0).otherwise(exons / 5)


def loss_class(df: DataFrame) -> DataFrame:
    """Adds ``loss``, the class of a projection, from flags and shares; the first rule that fits decides.

    Columns: is_paralog, exons, effective (mutations that count), ignore_m,
    intact_m, codons (shares), out_of_chain, all_missing, all_deleted,
    any_missing, missing_share, middle_intact, middle_present, single_deleted,
    single_missing, affected, big_exon_two, big_exon_deleted. A flag that is
    null counts as false.
    """
    c = {n: F.col(n) for n in df.columns}
    flag = lambda n: F.coalesce(c[n], F.lit(False))
    gone = F.when(c["out_of_chain"] > 0.5, "PM").otherwise("M")
    middle = (
        F.when(c["codons"] < 0.49, "UL").when(~flag("any_missing"), "I").when(flag("middle_present"), "I").when(c["missing_share"] < 0.5, "PI").otherwise(gone)
    )
    single = F.when(flag("single_deleted"), "L").when(flag("single_missing"), gone).when((c["ignore_m"] < 0.6) & (c["effective"] >= 2), "L").otherwise("UL")
    low = F.when(c["affected"] >= needed_exons(c["exons"]), "L").when(flag("big_exon_two"), "L").when(flag("big_exon_deleted"), "L").otherwise("UL")
    several = F.when(c["intact_m"] < 0.6, low).when(c["out_of_chain"] > 0.5, "PM").otherwise("UL")
    ladder = (
        F.when(flag("is_paralog"), "PG")
        .when(c["exons"].isNull() | (c["exons"] == 0), "N")
        .when((c["effective"] == 0) & (c["ignore_m"] > 0.6), "I")
        .when(c["codons"] < 0.35, F.when(c["out_of_chain"] > 0.65, "M").otherwise("L"))
        .when(flag("all_missing"), gone)
        .when(flag("all_deleted"), "L")
        .when(c["intact_m"] < 0.2, "L")
        .when(flag("middle_intact"), middle)
        .when(c["exons"] == 1, single)
        .otherwise(several)
    )
    return df.withColumn("loss", ladder)


def roll_up(projections: DataFrame, isoforms: DataFrame, predefined: DataFrame | None = None) -> DataFrame:
    """(level, id, class) of projections, transcripts and genes; each level has the best class of its parts.

    ``projections``: projection, transcript, loss; ``isoforms``: gene,
    transcript; ``predefined``: level, id, class, which replaces the class found
    of a projection or transcript, or adds it.
    """
    given = None if predefined is None else predefined.select("level", "id", F.col("class").alias("__given"))

    def override(rows: DataFrame, level: str) -> DataFrame:
        if given is None:
            return rows
        fixed = given.where(F.col("level") == level).select("id", "__given")
        return rows.join(fixed, "id", "full").select("id", F.coalesce("__given", "class").alias("class"))

    def best(rows: DataFrame, by: str) -> DataFrame:
        return rows.groupBy(F.col(by).alias("id")).agg(label_of(F.max(rank_of(F.col("class")))).alias("class"))

    first = override(projections.select(F.col("projection").alias("id"), F.col("loss").alias("class")), "PROJECTION")
    owners = projections.select(F.col("projection").alias("id"), "transcript")
    second = override(best(first.join(owners, "id"), "transcript"), "TRANSCRIPT")
    third = best(second.withColumnRenamed("id", "transcript").join(isoforms, "transcript"), "gene")
    levels = [(first, "PROJECTION"), (second, "TRANSCRIPT"), (third, "GENE")]
    parts = [rows.select(F.lit(level).alias("level"), "id", "class") for rows, level in levels]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def confidence(marks: DataFrame, scores: DataFrame, least_score: float = 0.95) -> DataFrame:
    """Confidence of a projection from its exons' marks (HQ, AQ, LQ, NA) and score.

    Any LQ makes it low, else any NA partial, else all HQ and the score high, else average.
    """
    flags = marks.groupBy("projection").agg(F.bool_or(F.col("mark") == "LQ").alias("lq"), F.bool_or(F.col("mark") == "NA").alias("na"), F.bool_and(F.col("mark") == "HQ").alias("hq"))
    joined = flags.join(scores, "projection", "left")
    high = F.col("hq") & (F.coalesce("score", F.lit(0.0)) >= least_score)
    return joined.select("projection", F.when(F.col("lq"), "low_confidence").when(F.col("na"), "partial").when(high, "high_confidence").otherwise("average_confidence").alias("confidence_level"))


def exon_mark(kind: Column, included: Column, identity: Column, score: Column) -> Column:
    """Mark of an aligned exon by class, place, percent identity and substitution score; null: the exon goes."""
    good, fair = (identity > 65) & (score > 40), (identity > 45) & (score > 25)
    whole = kind.isin("A", "A+", "B")
    likely = (whole & ~included) | ((kind == "C") & included)
    return F.when(whole & included, F.when(good, "HQ").otherwise("AQ")).when(likely, F.when(good, "AQ").when(fair, "LQ"))


def precedence(status: DataFrame, order: list[str], item: str = "item", label: str = "status") -> DataFrame:
    """Each item's best status over all assemblies, by an order of statuses; unknown ones come last."""
    table = F.create_map(*[F.lit(x) for i, s in enumerate(order) for x in (s, i)])
    place = F.coalesce(F.try_element_at(table, F.col(label)), F.lit(len(order)))
    return status.groupBy(item).agg(F.min_by(label, F.struct(place, label)).alias(label))


def assembly_counts(status: DataFrame, labels: list[str], assembly: str = "assembly", label: str = "status") -> DataFrame:
    """Statuses of each assembly counted, and grouped as intact, inactivated and missing."""
    counts = [F.count(F.when(F.col(label) == s, 1)).alias(s) for s in labels]
    table = status.groupBy(assembly).agg(*counts)
    add = lambda names: sum([F.coalesce(F.col(n), F.lit(0)) for n in names if n in labels], F.lit(0))
    return table.withColumns({"intact": add(["I"]), "inactivated": add(["L", "UL"]), "missing": add(["PI", "M", "PM", "PG", "N", "abs"])})


def status_matrix(status: DataFrame, assemblies: list[str], item: str = "item", assembly: str = "assembly", label: str = "status") -> DataFrame:
    """A column per assembly with each item's status; ``abs`` where it has none."""
    wide = status.groupBy(item).pivot(assembly, assemblies).agg(F.max(label))
    return wide.fillna("abs")


def loss_features(mutations: DataFrame, shares: DataFrame, exons: DataFrame, out_of_chain: DataFrame, paralogs: DataFrame, key: str) -> DataFrame:
    """The columns of ``loss_class`` for each projection of ``exons`` (key, exon, size).

    ``mutations`` and ``shares`` of a ``frame_report``; ``out_of_chain``: key,
    out_of_chain; ``paralogs``: key. Mutations that are not masked count, and missing exons in any case;
    in exons that are gone no others do. An exon is big if it has over 40 % of the bases.
    """
    missing, deleted = F.col("mclass") == "Missing exon", F.col("mclass") == "Deleted exon"
    counting = mutations.where((~F.col("masked") | missing) & (F.col("mclass") != "COMPENSATION"))
    per_exon = counting.groupBy(key, "exon").agg(F.count(F.when(~missing & ~deleted, 1)).alias("small"), F.bool_or(missing).alias("m"), F.bool_or(deleted).alias("d"))
    effective = counting.groupBy(key).agg(F.count(F.lit(1)).alias("effective"))
    rows = exons.select(key, "exon", "size").join(per_exon, [key, "exon"], "left").withColumn("total", F.sum("size").over(Window.partitionBy(key)))
    gone, lost = F.coalesce("d", F.lit(False)), F.coalesce("m", F.lit(False)) & ~F.coalesce("d", F.lit(False))
    rows = rows.withColumns({"d": gone, "m": lost, "small": F.when(gone | lost, 0).otherwise(F.coalesce("small", F.lit(0))), "big": F.coalesce(F.try_divide("size", "total") > 0.4, F.lit(True))})
    one = F.count(F.lit(1)) == 1
    found = rows.groupBy(key).agg(
        F.count(F.lit(1)).alias("exons"), F.bool_and("m").alias("all_missing"), F.bool_and("d").alias("all_deleted"), F.bool_or("m").alias("any_missing"),
        F.try_divide(F.sum(F.when(F.col("m"), F.col("size")).otherwise(0)), F.max("total")).alias("missing_share"), (one & F.bool_or("d")).alias("single_deleted"), (one & F.bool_or("m")).alias("single_missing"),
        F.count(F.when(F.col("d") | (F.col("small") > 0), 1)).alias("affected"), F.bool_or(F.col("big") & (F.col("small") >= 2)).alias("big_exon_two"), F.bool_or(F.col("big") & F.col("d")).alias("big_exon_deleted"),
    )
    found = found.join(effective, key, "left").join(shares, key, "left").join(out_of_chain, key, "left").join(paralogs.select(key, F.lit(True).alias("is_paralog")).distinct(), key, "left")
    default = lambda c, v: F.coalesce(c, F.lit(v))
    return found.select(
        key, *[c for c in ("exons", "all_missing", "all_deleted", "any_missing", "missing_share", "single_deleted", "single_missing", "affected", "big_exon_two", "big_exon_deleted")],
        default("is_paralog", False).alias("is_paralog"), default("effective", 0).alias("effective"), default("ignore_m", -1.0).alias("ignore_m"), default("intact_m", -1.0).alias("intact_m"), default("intact_codons", -1.0).alias("codons"),
        default("out_of_chain", 0.0).alias("out_of_chain"), F.col("middle_is_intact").alias("middle_intact"), F.col("middle_is_present").alias("middle_present"),
    )
