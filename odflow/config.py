"""Settings of a run, and the binding of a user's column names to roles."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class ColumnBinding:
    """Names in the input files; bind() selects, casts and renames them at the source."""

    tile_id: str = "tile_ID"
    tile_geometry: str = "geometry"
    oa_id: str = "oa_ID"
    oa_geometry: str = "geometry"
    flow_origin: str = "origin"
    flow_destination: str = "destination"
    flow_flows: str = "flow"

    def bind_flows(self, df: DataFrame) -> DataFrame:
        return bind(df, {self.flow_origin: ("origin", "string"), self.flow_destination: ("destination", "string"), self.flow_flows: ("flow", "long")})

    def bind_tiles(self, df: DataFrame) -> DataFrame:
        return bind(df, {self.tile_id: ("tile_id", "string"), self.tile_geometry: ("shape", None)})

    def bind_areas(self, df: DataFrame) -> DataFrame:
        return bind(df, {self.oa_id: ("loc_id", "string"), self.oa_geometry: ("shape", None)})


def bind(df: DataFrame, roles: dict[str, tuple[str, str | None]]) -> DataFrame:
    """The role columns only, cast and renamed."""
    missing = [c for c in roles if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df.select(*[(F.col(f"`{c}`").cast(kind) if kind else F.col(f"`{c}`")).alias(name) for c, (name, kind) in roles.items()])


@dataclass(frozen=True)
class EngineConfig:
    batch_size: int = 1
    test_batch_size: int = 1
    epochs: int = 15
    lr: float = 5e-6
    momentum: float = 0.9
    seed: int = 1234
    log_interval: int = 1
    device: str = "cpu"
    mode: str = "train"
    model: str = "DG"
    workers: int = 8
    dropout: float = 0.0
    tessellation_area: str = "United Kingdom"
    tessellation_size: float = 25000
    dataset: str = "new_york"
    columns: ColumnBinding = field(default_factory=ColumnBinding)
    dim_dests: int = 512
    frac_true_dest: float = 0.0

    def __post_init__(self) -> None:
        if self.device != "cpu":
            raise ValueError(f"the device {self.device!r} is not offered: models run on the executors' processors, device cpu")
