"""Options of a topology."""

from __future__ import annotations

from dataclasses import asdict, dataclass, replace


@dataclass(frozen=True)
class TopologyOptions:
    """The twelve options. Defaults are those of a whole topology; stage_options() gives those of a
    single stage. `True` stands for a default amount: see quantum() and epsilon()."""

    topology: bool = True
    prequantize: bool | float = True
    topoquantize: bool | float = False
    presimplify: bool | float = False
    toposimplify: bool | float = False
    shared_coords: bool = False
    prevent_oversimplify: bool = True
    simplify_with: str = "shapely"
    simplify_algorithm: str = "dp"
    winding_order: str | None = "CW_CCW"
    object_name: str | list[str] = "data"
    ignore_index: bool = False

    def __post_init__(self):
        if self.winding_order not in (None, "CW_CCW", "CCW_CW"):
            raise NameError(f"winding_order {self.winding_order!r}: CW_CCW, CCW_CW or None")
        if self.simplify_with not in ("shapely", "simplification"):
            raise NameError(f"simplify_with {self.simplify_with!r}: shapely or simplification")
        if self.simplify_algorithm not in ("dp", "vw"):
            raise NameError(f"simplify_algorithm {self.simplify_algorithm!r}: dp or vw")

    @property
    def names(self) -> list[str]:
        return [self.object_name] if isinstance(self.object_name, str) else list(self.object_name)

    def changed(self, **new) -> TopologyOptions:
        return replace(self, **new)

    def to_dict(self) -> dict:
        return asdict(self) | {"object_name": self.names}


def stage_options(**own) -> TopologyOptions:
    """The defaults of a stage used alone: no quantization, no winding."""
    return TopologyOptions(**{"prequantize": False, "winding_order": None} | own)


def quantum(value: bool | float) -> float:
    """Quantization factor; 0 is none."""
    return 1e5 if value is True else float(value or 0)


def epsilon(value: bool | float, default: float) -> float:
    """Simplification amount; 0 is none. `presimplify=True` is 1, `toposimplify=True` is 1e-4."""
    return default if value is True else float(value or 0)
