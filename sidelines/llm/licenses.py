"""License scans with DataFrame functions alone: MinHash bands over overlapping windows, then exact shingle containment."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Notices of common licenses. Numbers inside stand for any version with as many parts.
NOTICES = [
    ("MIT", "Released under the MIT License."),
    ("Apache", "Licensed under the Apache License, Version 2.0."),
    ("GPL", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC", "Licensed under CC BY-NC 4.0."),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("MIT-text", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("MPL", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("GPL-text", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("LGPL", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License"),
    ("CC-BY-SA", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
]

SHINGLE, STEP = 3, 4
#: Bands of one row. A window of 2 * STEP shingles holds each run of STEP + 1 or fewer whole; a notice of three shingles
#: or more then resembles a window by at least 3 / 8, so 14 bands meet with probability 1 - (5 / 8) ** 14 = 0.9986.
BANDS = 14
LEAST_SHINGLES = 3
#: A band orders the shingles' hashes by their bits turned over where its mask has ones.
MASKS = [(band * 0x9E3779B97F4A7C15 + 0x1F83D9ABFB41BD6B) % (1 << 64) - (1 << 63) for band in range(BANDS)]


def words(text: Column) -> Column:
    """Runs of a-z and digits of the lower-cased text, digits as 0 (so versions of as many parts are alike)."""
    plain = F.translate(F.lower(F.coalesce(text, F.lit(""))), "123456789", "000000000")
    return F.filter(F.split(plain, "[^a-z0]+"), lambda w: w != "")


def shingles(text: str = "words") -> Column:
    """64-bit hashes of SHINGLE words in a row."""
    w = F.col(text)
    n = F.size(w) - (SHINGLE - 1)
    hashed = F.transform(F.sequence(F.lit(1), n), lambda i: F.xxhash64(*(F.element_at(w, i + k) for k in range(SHINGLE))))
    return F.when(n > 0, hashed).otherwise(F.array().cast("array<bigint>"))


def _keys(hashes: str) -> Column:
    """The least of an array of hashes in each band's order. Lambdas, as 14 x 8 terms spelled out make a method too long
    for the JVM to compile."""
    masks = F.array(*(F.lit(m) for m in MASKS))
    return F.transform(masks, lambda m: F.array_min(F.transform(hashes, lambda x: x.bitwiseXOR(m))))


def templates(spark: SparkSession, notices: list[tuple[str, str]] | None = None) -> DataFrame:
    """(license, template, n_shingles, needed): needed are the different shingles of a notice."""
    rows = spark.createDataFrame(NOTICES if notices is None else notices, "license string, template string").where("template is not null")
    rows = rows.withColumn("words", words(F.col("template"))).withColumn("needed", F.array_distinct(shingles()))
    return rows.withColumn("n_shingles", F.size("needed")).where(F.col("n_shingles") >= LEAST_SHINGLES).drop("words")


def _pieces(rows: DataFrame) -> DataFrame:
    """Runs of STEP + 1 shingles of each template, one by one and the last ending with it."""
    n = F.col("n_shingles")
    starts = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), n - STEP - 1)), lambda i: i + 1)
    piece = F.explode(F.transform(starts, lambda i: F.slice("needed", i, STEP + 1)))
    return rows.select("license", piece.alias("piece"))


def license_matches(docs: DataFrame, notices: list[tuple[str, str]] | None = None, least: float = 0.8) -> DataFrame:
    """(doc_id, license, containment, first_shingle): one row for each row of docs(doc_id, text) and license of which the
    text holds at least the share `least` of the shingles, wherever in it, if one of its windows met the license in a band.

    Windows of 2 * STEP shingles begin every STEP shingles of the whole text. A window's keys are its least hashes under
    BANDS permutations; windows that share a key with a piece of a notice are retrieved, and the notice's shingles in
    the whole text are counted exactly. A text none of whose windows meets a key of the notice is missed, at most about
    0.14 % for an exact notice of three shingles and less for longer ones. Notices are a bounded list, broadcast. Null, empty and shorter texts match nothing; null
    doc_ids match like others; rows with equal doc_id and text are one. Notices under LEAST_SHINGLES shingles are left
    out. Other columns are left out.
    """
    spark = docs.sparkSession
    wanted = templates(spark, notices)
    band_keys = _pieces(wanted).select("license", F.posexplode(_keys("piece")).alias("band", "key")).distinct()
    listed = sorted(r[0] for r in band_keys.select("key").distinct().collect())
    known = F.array(*(F.lit(x) for x in sorted({x for r in wanted.select("needed").collect() for x in r[0]}))).cast("array<bigint>")

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_key"), words(F.col("text").cast("string")).alias("words"))
    hashed = texts.select("doc_id", "text_key", shingles().alias("h")).withColumn("mine", F.array_intersect("h", known))
    # No filter or inner explode on these arrays: it would be pushed below them and split each text once for each of its words.
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("h") - STEP), F.lit(STEP))
    windows = hashed.select("doc_id", "text_key", "mine", F.explode_outer(F.transform(starts, lambda i: F.struct(i.alias("at"), F.slice("h", i, 2 * STEP).alias("window")))).alias("w"))
    windows = windows.select("doc_id", "text_key", "mine", F.col("w.at").alias("at"), F.col("w.window").alias("window")).where("size(window) > 0")
    kept = windows.withColumn("keys", _keys("window")).where(F.exists("keys", lambda k: k.isin(listed)))
    met = (
        kept.select("doc_id", "text_key", "mine", "at", "window", F.posexplode("keys").alias("band", "key"))
        .join(F.broadcast(band_keys), ["band", "key"])
        .select("doc_id", "text_key", "mine", "at", "window", "license")
        .distinct()
        .join(F.broadcast(wanted), "license")
        .where(F.size(F.array_intersect("window", "needed")) > 0)
        .select("doc_id", "text_key", "license", "n_shingles", "at", F.size(F.array_intersect("mine", "needed")).alias("held"))
    )
    found = met.groupBy("doc_id", "text_key", "license", "n_shingles").agg(F.min("at").alias("first_shingle"), F.max("held").alias("held"))
    share = F.col("held") / F.col("n_shingles")
    return found.where(share >= least).select("doc_id", "license", share.alias("containment"), "first_shingle")
