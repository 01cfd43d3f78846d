"""Reproducible samples and the linkage joins that build evaluation sets
(L1-L3, J1-J3).

Sampling orders rows by ``md5(id || '|' || seed)``: exact size, reproducible,
and the same order in any engine.  ``orderBy(..).limit(n)`` plans as
TakeOrderedAndProject (each task keeps n rows), replicates as a
``row_number() <= n`` window that Spark limits per partition before the
shuffle, so no task ever sees more than n rows per replicate from each input
partition.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reclink.session import materialize


def sample_key(id_col: str, seed) -> F.Column:
    seed_c = seed if isinstance(seed, F.Column) else F.lit(str(seed))
    return F.md5(F.concat(F.col(id_col).cast("string"), F.lit("|"), seed_c.cast("string")))


def sample_n(df: DataFrame, n: int, seed: int = 42, id_col: str = "id") -> DataFrame:
    """L1: exactly min(n, |df|) rows, chosen by seed."""
    return df.orderBy(sample_key(id_col, seed), F.col(id_col)).limit(n)


def replicate_samples(df: DataFrame, n: int, seeds, id_col: str = "id") -> DataFrame:
    """L3: one DataFrame holding a sample of n rows per seed, tagged replicate_id."""
    seeds = list(seeds)
    tagged = df.select("*", F.posexplode(F.array(*[F.lit(str(s)) for s in seeds])).alias("replicate_id", "_seed"))
    w = Window.partitionBy("replicate_id").orderBy(sample_key(id_col, F.col("_seed")), F.col(id_col))
    return (tagged.withColumn("_rn", F.row_number().over(w))
                  .where(F.col("_rn") <= n)
                  .drop("_rn", "_seed"))


def projects_of(sample_links: DataFrame, projects: DataFrame, proj_id: str = "id",
                link_proj: str = "proj_id", by=()) -> DataFrame:
    """Projects whose id occurs among the sample's (distinct) linked ids."""
    keys = list(by)
    ids = sample_links.select(*keys, F.col(link_proj).alias(proj_id)).distinct()
    if keys:
        return projects.join(ids, proj_id, "inner")
    return projects.join(ids, proj_id, "left_semi")


def any_link(sample: DataFrame, sample_links: DataFrame, kept_projects: DataFrame, *, pub_id: str = "id",
             link_pub: str = "pub_id", link_proj: str = "proj_id", proj_id: str = "id", by=()) -> DataFrame:
    """Sample rows with at least one link to a kept project (exact id match)."""
    keys = list(by)
    kept = kept_projects.select(*keys, F.col(proj_id).alias(link_proj))
    ok = (sample_links.join(kept, keys + [link_proj], "left_semi")
                      .select(*keys, F.col(link_pub).alias(pub_id)).distinct())
    return sample.join(ok, keys + [pub_id], "left_semi")


def linked_sample(pubs: DataFrame, links: DataFrame, projects: DataFrame, n: int, seed: int = 42, *,
                  pub_id: str = "id", proj_id: str = "id", link_pub: str = "pub_id",
                  link_proj: str = "proj_id"):
    """L2: sample n linked publications, keep projects they link to, then keep
    the sampled publications that still link to a kept project.

    ``projects`` should already carry the eligibility filter (P1).  Returns
    (publications, projects).
    """
    linked = pubs.join(links.select(F.col(link_pub).alias(pub_id)).distinct(), pub_id, "left_semi")
    # n rows, used three times: computed once; broadcasting it is size-bounded
    sample = materialize(sample_n(linked, n, seed, pub_id))
    s_links = links.join(F.broadcast(sample.select(F.col(pub_id).alias(link_pub))), link_pub, "left_semi")
    kept_projects = projects_of(s_links, projects, proj_id, link_proj)
    kept_pubs = any_link(sample, s_links, kept_projects, pub_id=pub_id, link_pub=link_pub,
                         link_proj=link_proj, proj_id=proj_id)
    return kept_pubs, kept_projects


def linked_replicates(pubs: DataFrame, links: DataFrame, projects: DataFrame, n: int, seeds, *,
                      pub_id: str = "id", proj_id: str = "id", link_pub: str = "pub_id",
                      link_proj: str = "proj_id"):
    """L2 for every seed at once (L3); results carry replicate_id."""
    linked = pubs.join(links.select(F.col(link_pub).alias(pub_id)).distinct(), pub_id, "left_semi")
    sample = materialize(replicate_samples(linked, n, seeds, pub_id))
    # n rows per seed: a size-bounded broadcast side
    s_links = links.join(F.broadcast(sample.select("replicate_id", F.col(pub_id).alias(link_pub))),
                         link_pub, "inner")
    kept_projects = projects_of(s_links, projects, proj_id, link_proj, by=["replicate_id"])
    kept_pubs = any_link(sample, s_links, kept_projects, pub_id=pub_id, link_pub=link_pub,
                         link_proj=link_proj, proj_id=proj_id, by=["replicate_id"])
    return kept_pubs, kept_projects


def attach_participants(legacy: DataFrame, pubs: DataFrame, *, legacy_id: str = "cfPublId",
                        pub_id: str = "id", participants: str = "participants") -> DataFrame:
    """Rows with any NULL dropped, then a left join adding the participants."""
    right = pubs.select(F.col(pub_id).alias("_pid"), F.col(participants))
    return (legacy.na.drop("any")
                  .join(right, F.col(legacy_id) == F.col("_pid"), "left")
                  .drop("_pid"))
