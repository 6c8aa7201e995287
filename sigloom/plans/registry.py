"""Every registered query of the catalogue engine, with its SQL oracle where there is one."""

from sigloom.plans.oracles import ORACLE
from sigloom.plans.queries import QUERIES

__all__ = ["ORACLE", "QUERIES"]
