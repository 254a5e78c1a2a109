"""The declared schema of the scored table (O-2): names, order and types are fixed values."""

from __future__ import annotations

from pyspark.sql.types import DoubleType, IntegerType, StringType, StructField, StructType

# Fixed values, in file order: i integer, r real, s string.
_COLUMNS = """
F1 i, FIPS i, State s, County s, prediction i, probability_1 r, probability_0 r,
RuralUrbanContinuumCode2003 i, RuralUrbanContinuumCode2013 i, Metro2013 s, LandAreaSQMiles2010 r,
Low.Education i, Low.Employment i, Retirement.Destination i, TotalPopEst2011 i, TotalPopEst2015 i,
PopChangeRate0010 r, Population.loss.2015 i, Asian r, Black r, Hispanic r, MultipleRace r, NativeAmerican r,
White r, Non.English r, EuropeBorn r, MexBorn r, ForeignBorn r, AvgHHSize r, FemaleHHPct r, HH65PlusAlonePct r,
Med.Income i, OwnHome r, Under18 r, X65AndOlder r, UnempRate2011 r, UnempRate2015 r, LessHS r, HSOnly r,
SomeCollege r, AssocDegree r, CollegePlus r, Pov.All r, Pov.Under.18 r, Deep.Pov.All r, Deep.Pov.Child r,
Ag r, Const r, FIRE r, Gov r, Inf. r, Manf r, Mine r, EmpServ r, Trade r, Trans r,
Type.2015.Farming.NO i, Type.2015.Government.NO i, Type.2015.Manufacturing.NO i, Type.2015.Mining.NO i, Type.2015.Recreation.NO i
"""

_TYPES = {"i": IntegerType(), "r": DoubleType(), "s": StringType()}

SCORED_SCHEMA = StructType([StructField(name, _TYPES[kind]) for name, kind in (c.split() for c in _COLUMNS.split(","))])
