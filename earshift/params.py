"""Tunable values that change results.  Defaults are the published behaviour."""

from __future__ import annotations

from dataclasses import dataclass, field

# Tag families.  Rap is tested first, then the blocklist, then
# electronic; a tag that matches none is off-family.
RAP_PATTERNS = (
    "hip hop", "hip-hop", "rap", "trap", "drill", "grime", "crunk",
    "g-funk", "boom bap", "turntablism",
)
EDM_PATTERNS = (
    "house", "techno", "trance", "dubstep", "garage", "drum and bass", "dnb",
    "jungle", "breakbeat", "breaks", "big beat", "electro", "electronic",
    "electronica", "edm", "bass", "idm", "hardstyle", "gabber", "hardcore",
    "downtempo", "synthwave", "eurodance", "rave", "glitch", "trip hop",
)
EDM_BLOCKLIST = (
    "garage rock", "garage punk", "hardcore punk", "post-hardcore",
    "melodic hardcore", "metalcore", "deathcore", "grindcore",
)

# Words shown in capitals in report text.
ACRONYMS = (
    "edm", "r&b", "uk", "us", "usa", "idm", "dnb", "ebm", "nyc",
    "dj", "adhd", "lo-fi", "emo",
)


@dataclass(frozen=True)
class Params:
    # Events
    min_ms_played: int = 30_000
    poll_page_limit: int = 50

    # Attribution
    variants: dict[str, float] = field(
        default_factory=lambda: {"album_artist_only": 0.0, "with_features": 0.5}
    )
    default_variant: str = "with_features"
    top_tags_per_artist: int = 8
    # True: plays that share (ts, track) split one unit of credit between them,
    # so such a group counts its mean time.  False: every play counts in full.
    merge_shared_timestamps: bool = True

    # Trends
    rolling_months: int = 3
    slope_months: int = 12
    rel_threshold: float = 0.15
    min_share: float = 0.005
    skip_rate_floor: float = 50.0
    top_artist_fraction: float = 0.01

    # Outlook
    momentum_decay: float = 0.92
    horizon_months: int = 12
    lam: float = 2.0
    clamp: tuple[float, float] = (-0.9, 2.0)
    alpha: float = 0.5
    beta: float = 1.0

    # Recommendation
    seed_window_months: int = 18
    n_seeds: int = 120
    max_candidates: int = 400
    # "total_per_play": a track's all-time seconds count once per recent play.
    # "recent_seconds": only the seconds played inside the window count.
    seed_weight: str = "total_per_play"

    # Playlists
    n_playlists: int = 4
    playlist_size: int = 25
    anchor_tracks: int = 6
    tracks_per_artist: int = 2
    anchor_window_months: int = 18
    min_tag_count_for_anchor: int = 1
    override_tag_count: int = 1

    # Consolidation
    keep_below: float = 0.25
    drop_above: float = 0.60
    feature_weight: float = 0.5
    rap_patterns: tuple[str, ...] = RAP_PATTERNS
    edm_patterns: tuple[str, ...] = EDM_PATTERNS
    edm_blocklist: tuple[str, ...] = EDM_BLOCKLIST


DEFAULTS = Params()
