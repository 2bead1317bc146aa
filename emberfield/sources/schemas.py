"""Fixed column lists of the sampling files: header in the file, canonical name, type.

All columns are read as text and converted by rule, so one bad cell never fails a load.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T


@dataclass(frozen=True)
class Source:
    """A sampling file: its columns in file order as (header, canonical name, kind)."""

    name: str
    columns: tuple[tuple[str, str, str], ...]

    @property
    def text_schema(self) -> T.StructType:
        return T.StructType([T.StructField(canon, T.StringType()) for _, canon, _ in self.columns])

    def canonical(self, header: str) -> str | None:
        """Canonical name of a header; what stands between its letters and digits does not matter."""
        plain = lambda h: "".join(c for c in h.lower() if c.isalnum())
        names = {plain(h): name for h, name, _ in self.columns}
        return names.get(plain(header))

    @property
    def headers(self) -> list[str]:
        return [header for header, _, _ in self.columns]


# Headers of the daily coastal station file.
DAILY_STATION = Source(
    "daily_station",
    (
        ("Date", "date", "date"),
        ("Rainfall_BahíaColcura (mm)", "rainfall", "double"),
        ("Sun_Bahía Colcura(h)", "sun_exposure", "double"),
        ("SST (°C)", "temp", "double"),
        ("SSS (ppm)", "salinity", "double"),
        ("Total phytoplankton (No cells/L; surface)", "total_phytoplankton", "double"),
        ("Fluorescence (mg/m3)", "fluorescence", "double"),
        ("Fire intensity", "fire_intensity", "double"),
        ("Alexandrium spp.  (No cells/L; surface)", "alexandrium", "double"),
        ("Dinophysis spp.  (No cells/L; surface)", "dinophysis", "double"),
        ("Pseudo-nitzchia spp.  (No cells/L; surface)", "pseudo", "double"),
    ),
)

# Headers of the bay file, one row per sample and taxon.
BAY_TAXA = Source(
    "bay_taxa",
    (
        ("Taxonomic.Identification", "taxon", "string"),
        ("Date...2", "date", "date"),
        ("Density..cells.mL.", "density", "double"),
        ("Date...4", "date_unique", "date"),
        ("Total.Phyto", "total_phytoplankton", "double"),
        ("Dinophysis.spp.", "dinophysis", "double"),
        ("Pseudo.nitzschia.spp.", "pseudo", "double"),
        ("Alexandrium.spp.", "alexandrium", "flag"),
    ),
)

# Columns of the estuary station file.
ESTUARY_STATION = Source(
    "estuary_station",
    (
        ("Date", "date", "date"),
        ("rainfall", "rainfall", "double"),
        ("sun_exposure", "sun_exposure", "double"),
        ("temp", "temp", "double"),
        ("depth", "depth", "double"),
        ("total_phytoplankton", "total_phytoplankton", "double"),
        ("chlorophyll", "chlorophyll", "double"),
        ("alexandrium", "alexandrium", "double"),
        ("dinophysis", "dinophysis", "double"),
        ("pseudo", "pseudo", "double"),
    ),
)

# Columns used from the many-site harvest area file.
HARVEST_AREAS = Source(
    "harvest_areas",
    (
        ("CollectionDate", "date", "date"),
        ("Area", "area", "string"),
        ("Area2", "area2", "string"),
        ("Pseudo_Total", "pseudo", "double"),
        ("Alexandrium_Total", "alexandrium", "double"),
        ("Dinophysis_Total", "dinophysis", "double"),
    ),
)

SOURCES = {s.name: s for s in (DAILY_STATION, BAY_TAXA, ESTUARY_STATION, HARVEST_AREAS)}
