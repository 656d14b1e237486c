"""The given tables as listening data.  Every adapter keeps all rows.

part = track, supplier = artist, lineitem = play, customer = listener.  The
first three fifths of the suppliers form the library; the others are known only
as suppliers of single lines and act as undiscovered artists.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from earshift.functions.text import fold_name, title_key
from earshift.operators.consolidate import classify, family_weights, with_song_key
from earshift.operators.credits import track_credits
from earshift.operators.events import real_listens
from earshift.operators.resolve import no_tags
from earshift.operators.trends import tag_trends, tag_weights
from earshift.sources.tables import materialise

GENRES = (
    "hip hop", "trap", "drill", "grime", "boom bap", "hardcore hip hop", "gangsta rap", "house",
    "techno", "trance", "dubstep", "uk garage", "drum and bass", "electronic", "bass house",
    "hip house", "garage rock", "hardcore punk", "metalcore", "indie rock", "soul", "pop",
    "dancehall", "ambient", "heavy metal",
)


class Tables:
    """Lazy access to the given Parquet files and the views derived from them."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self._read: dict[str, DataFrame] = {}
        self._staged: dict[str, DataFrame] = {}

    def read(self, name: str) -> DataFrame:
        if name not in self._read:
            self._read[name] = self.spark.read.parquet(f"{self.path}/{name}.parquet")
        return self._read[name]

    def staged(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        """A result that several steps of one query share, written once."""
        if name not in self._staged:
            self._staged[name] = materialise(build(), name)
        return self._staged[name]

    def genre(self, i: Column) -> Column:
        names = F.array(*[F.lit(g) for g in GENRES])
        return F.element_at(names, (i % len(GENRES) + 1).cast("int"))

    def library_size(self) -> Column:
        n = self.read("supplier").agg(F.floor(F.count(F.lit(1)) * 3 / 5).alias("n"))
        return n.scalar()

    def artists(self) -> DataFrame:
        s = self.read("supplier")
        return s.select(
            F.col("s_suppkey").alias("artist_id"), F.col("s_name").alias("artist_name"),
            F.concat(F.lit("mb-"), "s_suppkey").alias("mbid"),
            F.col("s_nationkey").alias("nation"), "s_acctbal",
        )

    def tracks(self, titles: bool = True) -> DataFrame:
        """One row per part.  track_uri is NULL for the non-music part type.
        ``titles`` adds the performers and the title that names them."""
        key, n = F.col("p_partkey"), F.col("_n")
        p = self.read("part").withColumn("_n", self.library_size()).select(
            key.alias("part_id"), "p_name",
            F.when(F.col("p_type") != "PROMO", F.concat(F.lit("part:"), key)).alias("track_uri"),
            F.when(F.col("p_type") == "PROMO", F.concat(F.lit("part:"), key)).alias("episode_uri"),
            (F.col("p_size") % 6).alias("form"),
            (key % n).alias("home"), ((key * 3 + 1) % n).alias("feat"), ((key * 7 + 3) % n).alias("feat2"),
        )
        a = self.artists()
        p = p.join(a.select(F.col("artist_id").alias("home"), "artist_name", "nation"), "home")
        if not titles:
            return p.select("part_id", "track_uri", "episode_uri", "artist_name", "nation")
        for guest in ("feat", "feat2"):
            p = p.join(
                a.select(F.col("artist_id").alias(guest), F.col("artist_name").alias(f"{guest}_name")),
                guest,
            )
        suffix = (
            F.when(F.col("form") == 0, F.concat(F.lit(" (feat. "), "feat_name", F.lit(")")))
            .when(F.col("form") == 1, F.concat(
                F.lit(" [with "), "feat_name", F.lit(" & "), "feat2_name", F.lit("]")))
            .when(F.col("form") == 2, " - 2020 Remaster").when(F.col("form") == 3, " (Radio Edit)")
            .otherwise("")
        )
        performers = F.array(
            "artist_name", F.when(F.col("form") <= 1, F.col("feat_name")),
            F.when(F.col("form") == 1, F.col("feat2_name")),
        )
        return p.select(
            "part_id", "track_uri", "episode_uri", "artist_name", "nation",
            F.concat("p_name", suffix).alias("track_name"), F.col("p_name").alias("album_name"),
            F.array_compact(performers).alias("performers"),
        )

    def plays_raw(self, listeners: bool = False, titles: bool = False) -> DataFrame:
        line = self.read("lineitem")
        months = (F.year("l_shipdate") - 2000) * 12 + F.month("l_shipdate") - 5
        tilt = 1.0 + (F.col("nation") - 12) / 12.0 * 0.95 * F.greatest(months, F.lit(0)) / 18.0
        ms = F.round(F.col("l_quantity") * 6000.0 * tilt).cast("bigint")
        out = line.join(self.tracks(titles), F.col("l_partkey") == F.col("part_id"))
        cols = [
            F.col("l_shipdate").alias("ts"), F.col("l_linestatus").alias("platform"),
            ms.alias("ms_played"), "artist_name", "track_uri", "episode_uri",
            F.when((F.col("l_linestatus") == "O") & (F.col("l_linenumber") > 5), "fwdbtn")
            .otherwise("trackdone").alias("reason_end"),
            F.when(F.col("l_returnflag") == "R", True).when(F.col("l_returnflag") == "A", False)
            .alias("skipped"),
            F.concat(F.lit("f"), "l_linenumber").alias("source_file"),
            F.lit("audio").alias("source_kind"),
            F.when(F.col("track_uri").isNotNull(), "music").otherwise("podcast").alias("content_type"),
            (ms / 1000.0).alias("played_seconds"),
            F.trunc("l_shipdate", "month").alias("month"),
            F.lit(False).alias("ms_played_estimated"), F.lit(None).cast("string").alias("track_artists"),
        ]
        if titles:
            cols += ["track_name", "album_name"]
        if listeners:
            orders = self.read("orders").select(
                F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("user_id"))
            out = out.join(orders, "l_orderkey")
            cols.append("user_id")
        return out.select(*cols)

    def plays(self, listeners: bool = False, titles: bool = False) -> DataFrame:
        return real_listens(self.plays_raw(listeners, titles))

    def credits(self) -> DataFrame:
        """Performers per track, without listening totals."""
        t = self.tracks().where(F.col("track_uri").isNotNull())
        return t.select(
            "track_uri", "track_name", F.col("artist_name").alias("album_artist"),
            F.posexplode("performers").alias("_pos", "artist_name"),
        ).where((F.col("_pos") == 0) | (F.col("artist_name") != F.col("album_artist"))).select(
            "track_uri", "track_name", "album_artist", "artist_name",
            F.when(F.col("_pos") == 0, "album_artist").otherwise("featured").alias("credit_type"),
        )

    def artist_tags(self) -> DataFrame:
        return self.artists().select(
            "artist_name", "mbid", "nation", "s_acctbal",
            F.explode(F.sequence(F.lit(0), F.lit(9))).alias("k"),
        ).select(
            "artist_name", "mbid", self.genre(F.col("nation") + F.col("k")).alias("tag"),
            (40 - 15 * F.col("k")).alias("tag_count"),
            ((F.col("k") != 4) & (F.col("s_acctbal") < 9500)).alias("is_genre"),
        )

    def polled(self) -> DataFrame:
        """The whole play table again, seen 180 days later by the poller."""
        line = self.read("lineitem")
        out = line.join(self.tracks().where(F.col("track_uri").isNotNull()),
                        F.col("l_partkey") == F.col("part_id"))
        ts = F.col("l_shipdate") + F.expr("INTERVAL 180 DAYS")
        return out.select(
            ts.alias("ts"), F.lit("poll").alias("platform"), F.lit(240000).cast("bigint").alias("ms_played"),
            F.lit(True).alias("ms_played_estimated"), "artist_name", "track_name", "album_name",
            "track_uri", F.array_join("performers", "\u001f").alias("track_artists"),
            F.lit("poll").alias("source_kind"), F.lit("music").alias("content_type"),
        )

    def log(self) -> DataFrame:
        """What queries that read the plays several times need of them."""
        return self.staged("plays", lambda: self.plays(titles=True).select(
            "ts", "month", "track_uri", "artist_name", "track_name", "track_artists", "played_seconds"))

    def full_credits(self) -> DataFrame:
        return track_credits(self.plays(titles=True))

    def weights(self) -> DataFrame:
        return tag_weights(self.artist_tags())

    def trends(self, by: tuple[str, ...] = ()) -> DataFrame:
        return tag_trends(self.plays(listeners=bool(by)), self.credits(), self.weights(), by=by)

    def resolution(self) -> DataFrame:
        """Library artists; status from the account balance."""
        bal = F.col("s_acctbal")
        status = (
            F.when(bal < 0, "ambiguous").when(bal >= 9500, "not_found").when(bal >= 9000, "ignored")
            .otherwise("resolved")
        )
        a = self.artists().withColumn("_n", self.library_size()).where(F.col("artist_id") < F.col("_n"))
        return a.select(
            "artist_name", F.when(status == "resolved", F.col("mbid")).alias("mbid"), status.alias("status"),
            F.lit("musicbrainz").alias("source"), F.col("artist_name").alias("matched_name"),
            F.lit(100).alias("score"), F.lit(3).alias("n_candidates"),
            F.when(bal < 8000, 10).otherwise(0).alias("n_tags"), "nation", "artist_id", "s_acctbal",
        )

    def resolutions(self) -> DataFrame:
        """The same with tag lists, in the shape the resolver gives."""
        tags = F.when(F.col("n_tags") > 0, F.transform(F.sequence(F.lit(0), F.lit(9)), lambda k: F.struct(
            self.genre(F.col("nation") + k).alias("tag"), (40 - 15 * k).cast("bigint").alias("count"))))
        return self.resolution().select(
            "artist_name", "source", "status", "mbid", "score", "matched_name", "n_candidates",
            F.coalesce(tags, no_tags()).alias("tags"),
        )

    def vocabulary(self) -> DataFrame:
        """Genre terms, taken from the nations' order in the genre list."""
        return self.read("nation").select(self.genre(F.col("n_nationkey")).alias("term")).distinct()

    def artist_overrides(self) -> DataFrame:
        """Hand answers for artists of the first ten nations."""
        a = self.artists().where(F.col("nation") < 10)
        odd = F.col("nation") % 2 == 1
        return a.select(
            fold_name(F.col("artist_name")).alias("name_key"),
            F.when(odd & (F.col("s_acctbal") < 4000), F.concat(F.lit("pin-"), "artist_id")).alias("mbid"),
            (~odd & (F.col("s_acctbal") < 2000)).alias("ignore"), F.lit("by hand").alias("note"),
            F.when(F.col("s_acctbal") > 3000, F.array(
                self.genre(F.col("nation") + 3), F.lit("nonsense"), self.genre(F.col("nation") + 1)))
            .otherwise(F.array().cast("array<string>")).alias("tags"),
        )

    def lookups(self) -> DataFrame:
        return self.artists().where(F.col("s_acctbal") > 0).select(
            F.concat(F.lit("pin-"), "artist_id").alias("mbid"),
            F.concat(F.lit("The "), "artist_name").alias("name"),
            F.array(F.struct(self.genre(F.col("nation")).alias("tag"), F.lit(7).cast("bigint").alias("count"))).alias("tags"),
        )

    def names_to_resolve(self) -> DataFrame:
        return self.artists().select("artist_name").unionByName(
            self.read("nation").select(F.col("n_name").alias("artist_name")))

    def resolver_candidates(self) -> DataFrame:
        """Three search hits per supplier: an alias of another act, the act
        itself unless its balance is negative, and the act with an article."""
        tag = lambda i, n: F.struct(self.genre(F.col("nation") + i).alias("name"), F.lit(n).cast("bigint").alias("count"))
        no = F.array().cast("array<struct<name:string,count:bigint>>")
        bal, name = F.col("s_acctbal"), F.col("artist_name")
        hit = lambda pos, ident, n, aliases, score, tags: F.struct(
            F.lit(pos).alias("pos"), F.concat(F.lit(ident), "artist_id").alias("mbid"), n.alias("name"),
            aliases.alias("aliases"), F.lit(score).alias("score"), tags.alias("tags"))
        none = F.array().cast("array<string>")
        hits = F.array(
            hit(0, "other-", F.concat(F.lit("Reg "), name), F.when(bal >= 500, F.array(F.lower(name))).otherwise(none), 100, no),
            hit(1, "mb-", F.when(bal < 0, F.concat(name, F.lit("x"))).otherwise(F.upper(name)), none, 82,
                F.when(bal > 5000, F.array(tag(0, 3), tag(1, 1))).otherwise(no)),
            hit(2, "the-", F.when(bal < 0, F.lit("Band")).otherwise(F.concat(F.lit("The "), name)), none, 70,
                F.when(bal > 2000, F.array(tag(2, 5))).otherwise(no)),
        )
        return self.artists().select(F.col("artist_name").alias("query_name"), F.explode(hits).alias("h")).select(
            "query_name", "h.*")

    def release_tags(self) -> DataFrame:
        """One release per part: tags of the supplier's nation, votes 0 to 4."""
        line = self.read("lineitem").groupBy("l_suppkey", "l_partkey").agg(F.count(F.lit(1)).alias("n"))
        a = self.artists()
        return line.join(a, F.col("l_suppkey") == a.artist_id).select(
            "mbid", F.initcap(self.genre(F.col("nation") + F.col("l_partkey") % 4)).alias("name"),
            (F.col("l_partkey") % 5).cast("bigint").alias("count"))

    def edges(self) -> DataFrame:
        """A line links its part's artist to the supplier of the line."""
        line = self.read("lineitem").withColumn("_n", self.library_size()).groupBy(
            (F.col("l_partkey") % F.col("_n")).alias("home"), "l_suppkey"
        ).agg(F.sum("l_quantity").alias("score"))
        a = self.artists()
        return line.join(a, F.col("l_suppkey") == a.artist_id).select(
            F.concat(F.lit("mb-"), "home").alias("seed_mbid"), "mbid", F.col("artist_name").alias("name"), "score",
            F.concat(F.lit("nation "), "nation").alias("comment"))

    def candidate_tags(self) -> DataFrame:
        t = self.artist_tags()
        return t.select("mbid", "tag", F.greatest(F.col("tag_count"), F.lit(0)).cast("bigint").alias("count"))

    def supplied(self) -> DataFrame:
        """Distinct (supplier, part) pairs with the part's track."""
        pairs = self.read("lineitem").select("l_suppkey", "l_partkey").distinct()
        a = self.artists().select(F.col("artist_id").alias("l_suppkey"), F.col("artist_name").alias("supplier"),
                                  F.col("mbid").alias("supplier_mbid"), F.col("nation").alias("supplier_nation"))
        return pairs.join(self.tracks(), F.col("l_partkey") == F.col("part_id")).join(a, "l_suppkey")

    def artist_tracks(self) -> DataFrame:
        return self.supplied().select(
            F.col("supplier").alias("artist_name"), F.col("l_partkey").alias("rank"), "track_name", "track_uri",
            F.when(F.col("l_partkey") % 2 == 0, F.array("artist_name", F.upper("supplier")))
            .otherwise(F.array("artist_name")).alias("artists"))

    def genre_recordings(self) -> DataFrame:
        return self.supplied().select(
            F.col("supplier_mbid").alias("artist_mbid"),
            self.genre(F.col("supplier_nation") + F.col("l_partkey") % 10).alias("tag"),
            F.col("album_name").alias("title"))

    def playlist_items(self) -> DataFrame:
        line = self.read("lineitem")
        return line.join(self.tracks(), F.col("l_partkey") == F.col("part_id")).select(
            F.col("l_returnflag").alias("source"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("pos"),
            F.coalesce("track_uri", "episode_uri").alias("track_uri"), "track_name",
            F.col("performers").alias("artists"), F.date_format("l_shipdate", "yyyy-MM-dd").alias("added_at"))

    def consolidate_overrides(self) -> DataFrame:
        """Decisions for the titles of the two largest part sizes."""
        p = self.tracks().join(self.read("part").select(F.col("p_partkey").alias("part_id"), "p_size"), "part_id")
        return p.where(F.col("p_size") >= 49).select(
            title_key(F.col("track_name")).alias("title_key"), fold_name(F.col("artist_name")).alias("artist_key"),
            F.when(F.col("p_size") == 50, "keep").otherwise("drop").alias("decision"),
        ).groupBy("title_key", "artist_key").agg(F.min("decision").alias("decision"))

    def whole_and_filtered(self) -> tuple[DataFrame, DataFrame]:
        items = self.staged("items", lambda: with_song_key(self.playlist_items()))
        return items.where(F.col("source") == "A"), items.where(F.col("source") != "A")

    def filtered(self) -> DataFrame:
        """The items of the filtered playlists, for queries that need no other."""
        return self.playlist_items().where(F.col("source") != "A")

    def scored(self, items: DataFrame | None = None) -> DataFrame:
        items = self.whole_and_filtered()[1] if items is None else items
        return classify(items, family_weights(self.artist_tags()), self.consolidate_overrides())
