"""Element dimension table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Fixed values, in order of atomic number from 1: symbol, mass, van der Waals radius, covalent radius in angstrom.
TABLE = (
    ("H", 1.008, 1.10, 0.32),
    ("He", 4.003, 1.40, 0.37),
    ("Li", 6.940, 1.82, 1.30),
    ("Be", 9.012, 1.53, 0.99),
    ("B", 10.810, 1.92, 0.84),
    ("C", 12.011, 1.70, 0.75),
    ("N", 14.007, 1.55, 0.71),
    ("O", 15.999, 1.52, 0.66),
    ("F", 18.998, 1.47, 0.60),
    ("Ne", 20.180, 1.54, 0.62),
    ("Na", 22.990, 2.27, 1.60),
    ("Mg", 24.305, 1.73, 1.40),
    ("Al", 26.982, 1.84, 1.24),
    ("Si", 28.085, 2.10, 1.14),
    ("P", 30.974, 1.80, 1.09),
    ("S", 32.060, 1.80, 1.04),
    ("Cl", 35.450, 1.75, 1.00),
    ("Ar", 39.950, 1.88, 1.01),
    ("K", 39.098, 2.75, 2.00),
    ("Ca", 40.078, 2.31, 1.74),
    ("Sc", 44.956, 2.15, 1.59),
    ("Ti", 47.867, 2.11, 1.48),
    ("V", 50.942, 2.07, 1.44),
    ("Cr", 51.996, 2.06, 1.30),
    ("Mn", 54.938, 2.05, 1.29),
    ("Fe", 55.845, 2.04, 1.24),
    ("Co", 58.933, 2.00, 1.18),
    ("Ni", 58.693, 1.97, 1.17),
    ("Cu", 63.546, 1.96, 1.22),
    ("Zn", 65.380, 2.01, 1.20),
    ("Ga", 69.723, 1.87, 1.23),
    ("Ge", 72.630, 2.11, 1.20),
    ("As", 74.922, 1.85, 1.20),
    ("Se", 78.971, 1.90, 1.18),
    ("Br", 79.904, 1.85, 1.17),
    ("Kr", 83.798, 2.02, 1.16),
    ("Rb", 85.468, 3.03, 2.15),
    ("Sr", 87.620, 2.49, 1.90),
    ("Y", 88.906, 2.32, 1.76),
    ("Zr", 91.224, 2.23, 1.64),
    ("Nb", 92.906, 2.18, 1.56),
    ("Mo", 95.950, 2.17, 1.46),
    ("Tc", None, 2.16, 1.38),
    ("Ru", 101.070, 2.13, 1.36),
    ("Rh", 102.910, 2.10, 1.34),
    ("Pd", 106.420, 2.10, 1.30),
    ("Ag", 107.870, 2.11, 1.36),
    ("Cd", 112.410, 2.18, 1.40),
    ("In", 114.820, 1.93, 1.42),
    ("Sn", 118.710, 2.17, 1.40),
    ("Sb", 121.760, 2.06, 1.40),
    ("Te", 127.600, 2.06, 1.37),
    ("I", 126.900, 1.98, 1.36),
    ("Xe", 131.290, 2.16, 1.36),
    ("Cs", 132.910, 3.43, 2.38),
    ("Ba", 137.330, 2.68, 2.06),
    ("La", 138.910, 2.43, 1.94),
    ("Ce", 140.120, 2.42, 1.84),
    ("Pr", 140.910, 2.40, 1.90),
    ("Nd", 144.240, 2.39, 1.88),
    ("Pm", None, 2.38, 1.86),
    ("Sm", 150.360, 2.36, 1.85),
    ("Eu", 151.960, 2.35, 1.83),
    ("Gd", 157.250, 2.34, 1.82),
    ("Tb", 158.930, 2.33, 1.81),
    ("Dy", 162.500, 2.31, 1.80),
    ("Ho", 164.930, 2.30, 1.79),
    ("Er", 167.260, 2.29, 1.77),
    ("Tm", 168.930, 2.27, 1.77),
    ("Yb", 173.050, 2.26, 1.78),
    ("Lu", 174.970, 2.24, 1.74),
    ("Hf", 178.490, 2.23, 1.64),
    ("Ta", 180.950, 2.22, 1.58),
    ("W", 183.840, 2.18, 1.50),
    ("Re", 186.210, 2.16, 1.41),
    ("Os", 190.230, 2.16, 1.36),
    ("Ir", 192.220, 2.13, 1.32),
    ("Pt", 195.080, 2.13, 1.30),
    ("Au", 196.970, 2.14, 1.30),
    ("Hg", 200.590, 2.23, 1.32),
    ("Tl", 204.380, 1.96, 1.44),
    ("Pb", 207.200, 2.02, 1.45),
    ("Bi", 208.980, 2.07, 1.50),
    ("Po", None, 1.97, 1.42),
    ("At", None, 2.02, 1.48),
    ("Rn", None, 2.20, 1.46),
    ("Fr", None, 3.48, 2.42),
    ("Ra", None, 2.83, 2.11),
    ("Ac", None, 2.47, 2.01),
    ("Th", 232.040, 2.45, 1.90),
    ("Pa", 231.040, 2.43, 1.84),
    ("U", 238.030, 2.41, 1.83),
    ("Np", None, 2.39, 1.80),
    ("Pu", None, 2.43, 1.80),
    ("Am", None, 2.44, 1.73),
    ("Cm", None, 2.45, 1.68),
    ("Bk", None, 2.44, 1.68),
    ("Cf", None, 2.45, 1.68),
    ("Es", None, 2.45, 1.65),
    ("Fm", None, 2.45, 1.67),
    ("Md", None, 2.46, 1.73),
    ("No", None, 2.46, 1.76),
    ("Lr", None, 2.46, 1.61),
    ("Rf", None, None, 1.57),
    ("Db", None, None, 1.49),
    ("Sg", None, None, 1.43),
    ("Bh", None, None, 1.41),
    ("Hs", None, None, 1.34),
    ("Mt", None, None, 1.29),
    ("Ds", None, None, 1.28),
    ("Rg", None, None, 1.21),
    ("Cn", None, None, 1.22),
    ("Nh", None, None, 1.36),
    ("Fl", None, None, 1.43),
    ("Mc", None, None, 1.62),
    ("Lv", None, None, 1.75),
    ("Ts", None, None, 1.65),
    ("Og", None, None, 1.57),
)
#: Elements that never bond, and the scales of the neighbour search and of the bond length.
EXCLUDED = ("Li", "Na", "Mg", "K", "Ca", "Rb", "Sr", "Cs", "Ba", "Cu", "Ag", "Au", "Pt", "Zn", "Fe", "Co")
SEARCH_SCALE, BOND_SCALE = 1.164, 1.4


def rows() -> list[tuple]:
    """``(sym, mass, r_vdw, r_cov, z)``; the dummies D and X have zeros and no number."""
    return [(*row, z) for z, row in enumerate(TABLE, 1)] + [("D", 0.0, 0.0, 0.0, None), ("X", 0.0, 0.0, 0.0, None)]


def elements(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(rows(), "sym string, mass double, r_vdw double, r_cov double, z int")


def colour(z: int | None) -> str:
    """A colour per element for drawings: hues far apart for neighbours in the periodic table."""
    return "#cccccc" if not z else f"hsl({z * 137 % 360}, 60%, {45 + z % 3 * 10}%)"
