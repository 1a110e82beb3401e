"""Column roles, canonical schemas and the fixed names of the published data sets."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T


@dataclass(frozen=True)
class Roles:
    """Which column of a frame plays which part."""

    sensor: str = "sensor_id"
    ts: str = "reading_ts"
    value: str = "count"
    name: str = "sensor_name"


ROLES = Roles()

READINGS = T.StructType(
    [
        T.StructField("sensor_id", T.StringType()),
        T.StructField("sensor_name", T.StringType()),
        T.StructField("reading_ts", T.TimestampNTZType()),
        T.StructField("count", T.LongType()),
        T.StructField("latitude", T.DoubleType()),
        T.StructField("longitude", T.DoubleType()),
        T.StructField("ingestion_ts", T.TimestampNTZType()),
        T.StructField("reading_date", T.DateType()),
    ]
)

API_RECORD = T.StructType(
    [
        T.StructField("date", T.StringType()),
        T.StructField("sum_counts", T.DoubleType()),
        T.StructField("id_compteur", T.StringType()),
        T.StructField("nom_compteur", T.StringType()),
        T.StructField(
            "coordinates",
            T.StructType([T.StructField("lat", T.DoubleType()), T.StructField("lon", T.DoubleType())]),
        ),
    ]
)

# A record comes either bare or wrapped in "fields".
API_PAGE = T.StructType(
    [
        T.StructField("total_count", T.LongType()),
        T.StructField(
            "results",
            T.ArrayType(T.StructType([*API_RECORD.fields, T.StructField("fields", API_RECORD)])),
        ),
    ]
)

REGISTRY = T.StructType(
    [
        T.StructField("timestamp", T.StringType()),
        T.StructField("model_type", T.StringType()),
        T.StructField("env", T.StringType()),
        T.StructField("test_mode", T.BooleanType()),
        T.StructField("run_id", T.StringType()),
        T.StructField("model_uri", T.StringType()),
        T.StructField("is_champion", T.BooleanType()),
        T.StructField("rmse", T.DoubleType()),
        T.StructField("r2", T.DoubleType()),
        T.StructField("accuracy", T.DoubleType()),
        T.StructField("precision", T.DoubleType()),
        T.StructField("recall", T.DoubleType()),
        T.StructField("f1_score", T.DoubleType()),
    ]
)

AUDIT = T.StructType(
    [
        T.StructField("timestamp", T.TimestampNTZType()),
        T.StructField("drift_detected", T.BooleanType()),
        T.StructField("rmse", T.DoubleType()),
        T.StructField("r2", T.DoubleType()),
        T.StructField("fine_tune_triggered", T.BooleanType()),
        T.StructField("fine_tune_success", T.BooleanType()),
        T.StructField("model_improvement", T.DoubleType()),
        T.StructField("env", T.StringType()),
        T.StructField("error_message", T.StringType()),
        T.StructField("double_evaluation_enabled", T.BooleanType()),
        T.StructField("baseline_regression", T.BooleanType()),
        T.StructField("r2_baseline", T.DoubleType()),
        T.StructField("r2_current", T.DoubleType()),
        T.StructField("r2_train", T.DoubleType()),
        T.StructField("deployment_decision", T.StringType()),
        T.StructField("champion_r2_baseline", T.DoubleType()),
        T.StructField("model_uri", T.StringType()),
        T.StructField("run_id", T.StringType()),
    ]
)

# ---------------------------------------------------------------------------------------
# Names used by the published data files and their consumers.
# ---------------------------------------------------------------------------------------

RAW_HEADER_MAP = {
    "Identifiant du compteur": "identifiant_du_compteur",
    "Nom du compteur": "nom_du_compteur",
    "Identifiant du site de comptage": "identifiant_du_site_de_comptage",
    "Nom du site de comptage": "nom_du_site_de_comptage",
    "Comptage horaire": "comptage_horaire",
    "Date et heure de comptage": "date_et_heure_de_comptage",
    "Date d'installation du site de comptage": "date_installation_du_site_de_comptage",
    "Lien vers photo du site de comptage": "lien_vers_photo_du_site_de_comptage",
    "Coordonnées géographiques": "coordonnées_géographiques",
    "Identifiant technique compteur": "identifiant_technique_compteur",
    "ID Photos": "id_photos",
    "test_lien_vers_photos_du_site_de_comptage_": "test_lien_vers_photos_du_site_de_comptage",
    "id_photo_1": "id_photo_1",
    "url_sites": "url_sites",
    "type_dimage": "type_dimage",
    "mois_annee_comptage": "mois_annee_comptage",
}

API_NAME_MAP = {
    "sum_counts": "comptage_horaire",
    "date": "date_et_heure_de_comptage",
    "id_compteur": "identifiant_du_compteur",
    "nom_compteur": "nom_du_compteur",
    "coordinates": "coordonnees_geographiques",
}

REQUIRED_COLUMNS = [
    "comptage_horaire",
    "date_et_heure_de_comptage",
    "identifiant_du_compteur",
    "nom_du_compteur",
    "latitude",
    "longitude",
    "ingestion_ts",
]

UNUSED_COLUMNS = [
    "mois_annee_comptage",
    "identifiant_du_site_de_comptage",
    "identifiant_du_compteur",
    "nom_du_site_de_comptage",
    "lien_vers_photo_du_site_de_comptage",
    "identifiant_technique_compteur",
    "id_photos",
    "date_d_installation_du_site_de_comptage",
    "test_lien_vers_photos_du_site_de_comptage_",
    "id_photo_1",
    "url_sites",
    "type_dimage",
    "coordonnées_géographiques",
]

# Other spellings of the same columns, seen in files written by other normalizers.
NAME_ALIASES = {
    "date_installation_du_site_de_comptage": "date_d_installation_du_site_de_comptage",
    "test_lien_vers_photos_du_site_de_comptage": "test_lien_vers_photos_du_site_de_comptage_",
    "coordonnees_geographiques": "coordonnées_géographiques",
}

# Published names -> names used by this library.
CANONICAL_NAMES = {
    "identifiant_du_compteur": "sensor_id",
    "nom_du_compteur": "sensor_name",
    "date_et_heure_de_comptage": "reading_ts",
    "comptage_horaire": "count",
}

DATE_COLUMN_CANDIDATES = ["date", "Date et heure de comptage", "date_et_heure_de_comptage"]
COUNT_COLUMN_CANDIDATES = ["sum_counts", "Comptage horaire", "comptage_horaire"]
SENSOR_COLUMN_CANDIDATES = ["nom_compteur", "Nom du compteur", "nom_du_compteur", "id_compteur"]

DRIFT_EXCLUDE_PATTERNS = [
    "lien_",
    "url_",
    "photo",
    "ingestion_ts",
    "prediction_ts",
    "prediction",
    "id_photos",
    "id_photo",
    "identifiant_du_site",
    "identifiant_technique",
    "test_lien",
]

DRIFT_ALWAYS_KEEP = [
    "identifiant_du_compteur",
    "nom_du_compteur",
    "comptage_horaire",
    "latitude",
    "longitude",
]

YEAR_INDEX = {2024: 0, 2025: 1}
# The same index for any year.
YEAR_BASE = 2024

LOCAL_TIME_ZONE = "Europe/Paris"
