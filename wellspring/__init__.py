"""Life-cycle analysis of fuel technologies as Spark DataFrame jobs."""

from wellspring.params import LcaParams
from wellspring.plans.lca import LcaPlan
from wellspring.sources.mappings import Mappings
from wellspring.sources.tables import FactTables

__all__ = ["FactTables", "LcaParams", "LcaPlan", "Mappings"]
