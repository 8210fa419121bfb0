"""The regression models: seven biomes by four responses."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from ..operators.design import Term, model_terms
from ..operators.variance import VarianceModel

# Drivers of the models, and those tried in the variance function.
DRIVERS = (
    "LC_Tree",
    "LC_Shrub",
    "LC_Herbs",
    "DTR",
    "TMax",
    "PET",
    "LAI",
    "fPAR",
    "LC_Crop",
    "Precipitation",
    "NrWetDays",
    "RoadDensity_sqrt",
    "PopDensity_log",
    "DistUrbPop",
)
VARIANCE_DRIVERS = (
    "fPAR",
    "TMax",
    "Precipitation",
    "LC_Crop",
    "LC_Tree",
    "RoadDensity_sqrt",
    "PopDensity_log",
    "LC_Shrub",
    "LC_Herbs",
    "DistUrbPop",
)
DUMMY = "No_IDL"


@dataclass(frozen=True)
class FireModel:
    """Settings of one biome and response.

    ``without`` lists the drivers screened out as collinear. ``variances`` are
    the combined variance structures, the one kept for the mixed model first.
    ``candidates`` are the reduced fixed parts by the terms they leave out.
    ``outliers`` is how many of the most influential rows of the selected
    least-squares model are removed before everything is fitted again.
    """

    biome: int
    response: str
    transform: str
    without: tuple[str, ...]
    variances: tuple[str, ...] = ()
    candidates: Mapping[str, str] = field(default_factory=dict)
    final: str = "full"
    outliers: int = 0

    @property
    def drivers(self) -> tuple[str, ...]:
        return tuple(d for d in DRIVERS if d not in self.without)

    def columns(self) -> set[str]:
        """Scaled columns that any of its formulas or variance functions uses."""
        return {*self.drivers, *(c for v in self.variances for c in split_sum(v))}

    def linear(self) -> tuple[Term, ...]:
        return model_terms(self.drivers, (), DUMMY)

    def full(self) -> tuple[Term, ...]:
        return model_terms(self.drivers, self.drivers, DUMMY)

    def fixed_parts(self) -> dict[str, tuple[Term, ...]]:
        """The full quadratic formula and every reduced one."""
        parts = {"full": self.full()}
        for name, left_out in self.candidates.items():
            parts[name] = model_terms(self.drivers, self.drivers, DUMMY, [t.strip() for t in left_out.split(",")])
        return parts

    def variance_models(self) -> dict[str, VarianceModel]:
        """Equal variances, one covariate at a time, and the combinations."""
        full = self.full()
        models = {"equal": VarianceModel(full)}
        for d in VARIANCE_DRIVERS:
            if d not in self.without:
                models[f"exp({d})"] = VarianceModel(full, (d,))
        for combined in self.variances:
            models[f"exp({combined})"] = VarianceModel(full, split_sum(combined))
        return models

    def mixed_models(self) -> dict[str, VarianceModel]:
        """Full model, every fixed part by maximum likelihood, final by REML."""
        covariates = split_sum(self.variances[0])
        parts = self.fixed_parts()
        models = {"full reml": VarianceModel(parts["full"], covariates)}
        for name, terms in parts.items():
            models[f"{name} ml"] = VarianceModel(terms, covariates, reml=False)
        models["final reml"] = VarianceModel(parts[self.final], covariates)
        return models


def split_sum(text: str) -> tuple[str, ...]:
    return tuple(part.strip() for part in text.split("+"))


# The settings of the 28 models.
MODELS = (
    FireModel(
        1, "Fire", "identity",
        without=("LAI",),
        candidates={
            "reduced1": "No_IDL:LC_Tree",
        },
        final="reduced1",
    ),
    FireModel(
        1, "Duration", "log",
        without=("LAI",),
        variances=(
            "TMax + LC_Shrub + Precipitation + LC_Herbs",
            "TMax + Precipitation + LC_Herbs",
        ),
        candidates={
            "reduced1": "No_IDL:I(LC_Herbs^2), No_IDL:fPAR",
            "reduced2": "I(PopDensity_log^2), No_IDL:I(LC_Herbs^2), No_IDL:I(PopDensity_log^2), No_IDL:fPAR",
            "reduced3": "I(TMax^2), No_IDL:I(LC_Herbs^2), No_IDL:I(TMax^2), No_IDL:fPAR",
        },
        final="reduced1",
        outliers=5,
    ),
    FireModel(
        1, "Ignitions", "cube_root",
        without=("LAI",),
        variances=(
            "Precipitation + LC_Herbs",
        ),
        candidates={
            "reduced1": "No_IDL:I(DistUrbPop^2), No_IDL:TMax",
        },
        final="reduced1",
    ),
    FireModel(
        1, "Size", "log",
        without=("LAI",),
        variances=(
            "TMax + RoadDensity_sqrt + Precipitation + PopDensity_log",
            "RoadDensity_sqrt + Precipitation + PopDensity_log",
            "Precipitation + PopDensity_log",
            "DistUrbPop + TMax + PopDensity_log",
            "RoadDensity_sqrt + Precipitation + DistUrbPop + TMax + PopDensity_log",
        ),
        candidates={
            "reduced1": "No_IDL:LC_Tree",
            "reduced2": "I(LC_Shrub^2), No_IDL:I(LC_Shrub^2), No_IDL:LC_Tree",
        },
        final="reduced1",
    ),
    FireModel(
        2, "Fire", "identity",
        without=("LAI", "PET", "NrWetDays",),
        candidates={
            "reduced1": "No_IDL:I(RoadDensity_sqrt^2)",
        },
        final="reduced1",
    ),
    FireModel(
        2, "Duration", "cube_root",
        without=("LAI", "PET",),
        variances=(
            "fPAR + Precipitation + LC_Herbs",
        ),
        candidates={
            "reduced1": "No_IDL:DTR, No_IDL:I(RoadDensity_sqrt^2)",
            "reduced2": "I(LC_Crop^2), No_IDL:DTR, No_IDL:I(LC_Crop^2), No_IDL:I(RoadDensity_sqrt^2)",
        },
        final="reduced2",
    ),
    FireModel(
        2, "Ignitions", "cube_root",
        without=("LAI", "PET",),
        variances=(
            "Precipitation + PopDensity_log",
        ),
        candidates={
            "reduced1": "No_IDL:LC_Crop, No_IDL:RoadDensity_sqrt",
            "reduced2": "No_IDL:LC_Crop, No_IDL:RoadDensity_sqrt, No_IDL:fPAR, fPAR",
        },
        final="reduced1",
    ),
    FireModel(
        2, "Size", "log",
        without=("LAI", "PET",),
        variances=(
            "TMax + LC_Tree + PopDensity_log + RoadDensity_sqrt",
        ),
        final="full",
    ),
    FireModel(
        4, "Fire", "identity",
        without=("LAI", "PET",),
        candidates={
            "reduced1": "No_IDL:DTR",
        },
        final="reduced1",
    ),
    FireModel(
        4, "Duration", "cube_root",
        without=("LAI", "PET",),
        variances=(
            "fPAR + LC_Crop + Precipitation + LC_Tree",
            "fPAR + Precipitation",
        ),
        candidates={
            "reduced1": "No_IDL:I(DistUrbPop^2), No_IDL:I(NrWetDays^2), No_IDL:I(PopDensity_log^2), No_IDL:I(Precipitation^2), No_IDL:I(RoadDensity_sqrt^2), No_IDL:I(TMax^2), No_IDL:RoadDensity_sqrt",
            "reduced2": "I(LC_Shrub^2), No_IDL:I(DistUrbPop^2), No_IDL:I(LC_Shrub^2), No_IDL:I(NrWetDays^2), No_IDL:I(PopDensity_log^2), No_IDL:I(Precipitation^2), No_IDL:I(RoadDensity_sqrt^2), No_IDL:I(TMax^2), No_IDL:RoadDensity_sqrt",
            "reduced3": "No_IDL:I(DistUrbPop^2), No_IDL:I(NrWetDays^2), No_IDL:I(PopDensity_log^2), No_IDL:I(Precipitation^2), No_IDL:I(RoadDensity_sqrt^2), No_IDL:I(TMax^2), No_IDL:RoadDensity_sqrt, No_IDL:fPAR, fPAR",
        },
        final="reduced1",
    ),
    FireModel(
        4, "Ignitions", "cube_root",
        without=("PET", "LAI",),
        variances=(
            "Precipitation + LC_Crop + LC_Tree + LC_Shrub + LC_Herbs",
            "LC_Crop + LC_Tree + LC_Shrub + LC_Herbs",
        ),
        candidates={
            "reduced1": "No_IDL:I(LC_Tree^2), No_IDL:I(PopDensity_log^2), No_IDL:I(RoadDensity_sqrt^2)",
            "reduced2": "No_IDL:I(LC_Tree^2), No_IDL:I(PopDensity_log^2), No_IDL:I(RoadDensity_sqrt^2), No_IDL:TMax, TMax",
            "reduced3": "No_IDL:I(LC_Tree^2), No_IDL:I(PopDensity_log^2), No_IDL:I(RoadDensity_sqrt^2), No_IDL:PopDensity_log, PopDensity_log",
        },
        final="reduced1",
    ),
    FireModel(
        4, "Size", "log",
        without=("LAI", "PET",),
        variances=(
            "LC_Tree + LC_Crop + LC_Shrub",
            "DistUrbPop + LC_Tree + LC_Crop + LC_Shrub",
            "Precipitation + LC_Tree + LC_Crop + LC_Shrub",
        ),
        candidates={
            "reduced1": "No_IDL:DistUrbPop, No_IDL:I(DTR^2), No_IDL:I(LC_Shrub^2), No_IDL:LC_Shrub, No_IDL:LC_Tree",
            "reduced2": "I(DistUrbPop^2), No_IDL:DistUrbPop, No_IDL:I(DTR^2), No_IDL:I(DistUrbPop^2), No_IDL:I(LC_Shrub^2), No_IDL:LC_Shrub, No_IDL:LC_Tree",
        },
        final="reduced1",
    ),
    FireModel(
        6, "Fire", "identity",
        without=("LAI", "PET",),
        candidates={
            "reduced1": "No_IDL:I(LC_Herbs^2), No_IDL:I(LC_Tree^2), No_IDL:PopDensity_log",
            "reduced2": "No_IDL:I(LC_Herbs^2), No_IDL:I(LC_Tree^2), No_IDL:LC_Herbs, No_IDL:PopDensity_log, LC_Herbs",
        },
        final="reduced1",
    ),
    FireModel(
        6, "Duration", "cube_root",
        without=("LAI", "PET",),
        variances=(
            "TMax + RoadDensity_sqrt + PopDensity_log + LC_Crop",
            "TMax + LC_Shrub + Precipitation + LC_Herbs",
        ),
        candidates={
            "reduced1": "No_IDL:I(PopDensity_log^2), No_IDL:LC_Crop, No_IDL:PopDensity_log",
            "reduced2": "DistUrbPop, No_IDL:DistUrbPop, No_IDL:I(PopDensity_log^2), No_IDL:LC_Crop, No_IDL:PopDensity_log",
        },
        final="reduced1",
    ),
    FireModel(
        6, "Ignitions", "sqrt",
        without=("LAI", "PET",),
        variances=(
            "Precipitation + fPAR",
        ),
        candidates={
            "reduced1": "No_IDL:I(RoadDensity_sqrt^2)",
            "reduced2": "I(LC_Herbs^2), No_IDL:I(LC_Herbs^2), No_IDL:I(RoadDensity_sqrt^2)",
            "reduced3": "No_IDL:I(RoadDensity_sqrt^2), No_IDL:PopDensity_log, PopDensity_log",
        },
        final="reduced1",
    ),
    FireModel(
        6, "Size", "log",
        without=("LAI", "PET",),
        variances=(
            "TMax + LC_Crop + PopDensity_log",
        ),
        candidates={
            "reduced1": "No_IDL:DistUrbPop, No_IDL:I(DistUrbPop^2), No_IDL:I(PopDensity_log^2)",
            "reduced2": "I(DTR^2), No_IDL:DistUrbPop, No_IDL:I(DTR^2), No_IDL:I(DistUrbPop^2), No_IDL:I(PopDensity_log^2)",
        },
        final="reduced1",
    ),
    FireModel(
        7, "Fire", "identity",
        without=("PET", "LAI", "NrWetDays",),
        final="full",
    ),
    FireModel(
        7, "Duration", "cube_root",
        without=("PET", "LAI", "NrWetDays",),
        variances=(
            "DistUrbPop + PopDensity_log",
        ),
        candidates={
            "reduced1": "No_IDL:LC_Shrub, No_IDL:PopDensity_log, No_IDL:Precipitation",
        },
        final="full",
    ),
    FireModel(
        7, "Ignitions", "cube_root",
        without=("PET", "LAI", "NrWetDays",),
        variances=(
            "Precipitation + LC_Tree + PopDensity_log",
            "Precipitation + PopDensity_log",
        ),
        final="full",
    ),
    FireModel(
        7, "Size", "log",
        without=("PET", "LAI", "NrWetDays",),
        variances=(
            "fPAR + PopDensity_log",
            "DistUrbPop + PopDensity_log",
        ),
        final="full",
    ),
    FireModel(
        8, "Fire", "identity",
        without=("PET", "LAI",),
        candidates={
            "reduced1": "I(Precipitation^2), No_IDL:I(Precipitation^2)",
        },
        final="full",
    ),
    FireModel(
        8, "Duration", "cube_root",
        without=("PET", "LAI",),
        variances=(
            "Precipitation + LC_Crop + PopDensity_log",
            "Precipitation + PopDensity_log",
            "LC_Crop + PopDensity_log",
        ),
        candidates={
            "reduced1": "No_IDL:I(PopDensity_log^2), No_IDL:I(Precipitation^2), No_IDL:LC_Crop, No_IDL:fPAR",
            "reduced2": "No_IDL:I(PopDensity_log^2), No_IDL:I(Precipitation^2), No_IDL:LC_Crop, No_IDL:NrWetDays, No_IDL:fPAR, NrWetDays",
            "reduced3": "DTR, No_IDL:DTR, No_IDL:I(PopDensity_log^2), No_IDL:I(Precipitation^2), No_IDL:LC_Crop, No_IDL:fPAR",
        },
        final="reduced1",
    ),
    FireModel(
        8, "Ignitions", "cube_root",
        without=("PET", "LAI",),
        variances=(
            "Precipitation + LC_Shrub + LC_Herbs + PopDensity_log",
            "LC_Shrub + PopDensity_log",
        ),
        candidates={
            "reduced1": "No_IDL:DTR, No_IDL:I(RoadDensity_sqrt^2), No_IDL:LC_Herbs",
            "reduced2": "No_IDL:DTR, No_IDL:I(RoadDensity_sqrt^2), No_IDL:LC_Herbs, No_IDL:PopDensity_log, PopDensity_log",
            "reduced3": "DistUrbPop, No_IDL:DTR, No_IDL:DistUrbPop, No_IDL:I(RoadDensity_sqrt^2), No_IDL:LC_Herbs",
        },
        final="reduced1",
    ),
    FireModel(
        8, "Size", "log",
        without=("PET", "LAI",),
        variances=(
            "LC_Herbs + LC_Crop + PopDensity_log",
        ),
        candidates={
            "reduced1": "No_IDL:DTR, No_IDL:LC_Crop, No_IDL:LC_Shrub",
            "reduced2": "No_IDL:DTR, No_IDL:LC_Crop, No_IDL:LC_Shrub, LC_Crop",
            "reduced3": "I(fPAR^2), No_IDL:DTR, No_IDL:I(fPAR^2), No_IDL:LC_Crop, No_IDL:LC_Shrub",
            "reduced4": "I(NrWetDays^2), I(fPAR^2), No_IDL:DTR, No_IDL:I(NrWetDays^2), No_IDL:I(fPAR^2), No_IDL:LC_Crop, No_IDL:LC_Shrub",
        },
        final="reduced1",
    ),
    FireModel(
        13, "Fire", "identity",
        without=("LAI", "PET",),
        final="full",
    ),
    FireModel(
        13, "Duration", "cube_root",
        without=("LAI", "PET", "LC_Crop",),
        variances=(
            "RoadDensity_sqrt + PopDensity_log + LC_Tree",
        ),
        candidates={
            "reduced1": "No_IDL:I(fPAR^2), No_IDL:PopDensity_log",
        },
        final="reduced1",
    ),
    FireModel(
        13, "Ignitions", "cube_root",
        without=("LAI", "PET", "LC_Crop",),
        variances=(
            "RoadDensity_sqrt + PopDensity_log + DistUrbPop + fPAR",
        ),
        candidates={
            "reduced1": "No_IDL:DistUrbPop, No_IDL:I(DistUrbPop^2), No_IDL:I(RoadDensity_sqrt^2), No_IDL:I(fPAR^2)",
            "reduced2": "DistUrbPop, No_IDL:DistUrbPop, No_IDL:I(DistUrbPop^2), No_IDL:I(RoadDensity_sqrt^2), No_IDL:I(fPAR^2)",
        },
        final="reduced2",
    ),
    FireModel(
        13, "Size", "log",
        without=("LAI", "PET", "LC_Crop",),
        variances=(
            "fPAR + LC_Tree + PopDensity_log + RoadDensity_sqrt",
        ),
        candidates={
            "reduced1": "No_IDL:I(NrWetDays^2), No_IDL:I(PopDensity_log^2), No_IDL:NrWetDays",
            "reduced2": "I(NrWetDays^2), No_IDL:I(NrWetDays^2), No_IDL:I(PopDensity_log^2), No_IDL:NrWetDays",
        },
        final="reduced2",
    ),)
