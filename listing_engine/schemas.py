"""Schemas of the files the jobs read. Everything is read as text and cast."""

from __future__ import annotations

PORTAL_A = (
    "id_inmueble link_inmueble link_inmueble_siguiente titulo localizacion municipio precio precio_bajada metros_cuadrados "
    "habitaciones banos consumo_energia emisiones_energia descripcion breadcrumb fotos_total ref_catastral "
    "edificabilidad_m2techo parcela_m2 parcela_min_m2 fachada_min_m altura_max_m sector_urbanistico anunciante zona fecha_inclusion"
).split()
PORTAL_B = (
    "id_inmueble titulo localizacion precio metros_cuadrados m2_construidos m2_utiles habitaciones banos terraza estado planta "
    "exterior ascensor anunciante anunciante_link link_inmueble fecha_inclusion"
).split()
AGENCY_C = (
    "id_inmueble link_inmueble titulo localizacion precio metros_cuadrados habitaciones banos zona tipo_de_operacion "
    "fecha_inclusion lat lon"
).split()
SOURCES = {"a": PORTAL_A, "b": PORTAL_B, "c": AGENCY_C}

CLIENTS = (
    "id nombre telefono mail fecha_inclusion creado_info operation types conditions rooms_min rooms_max bath_min bath_max "
    "living_min living_max area_min_m2 area_max_m2 price_min_eur price_max_eur locations flags zona_std"
).split()
MATCHES = (
    "client_id client_name property_id link_inmueble web anunciante zona operacion tipo habitaciones banos m2 precio score "
    "s_price s_area s_rooms s_baths s_operation zone_match type_match rank_client"
).split()

TYPES = {
    "int": "habitaciones banos precio_bajada fotos_total edificabilidad_m2techo parcela_m2 parcela_min_m2 fachada_min_m altura_max_m m2_construidos m2_utiles".split(),
    "double": "precio metros_cuadrados lat lon".split(),
    "boolean": "terraza exterior ascensor".split(),
    "date": ["fecha_inclusion"],
}

# Header names accepted for each listing column, whole names.
HEADER_ALIASES = {
    "habitaciones": ("habitaciones", "rooms", "bedrooms"),
    "banos": ("baños", "bathrooms", "banos"),
    "precio": ("precio", "price"),
    "link_inmueble": ("link_inmueble", "url", "link"),
    "metros_cuadrados": ("metros_cuadrados", "size", "m2"),
    "anunciante": ("anunciante", "advertiser", "agent"),
    "zona": ("zona", "location", "area"),
    "web": ("web", "website"),
    "fecha_inclusion": ("fecha_inclusion", "date", "fecha"),
    "tipo_de_operacion": ("tipo_de_operacion", "operation_type", "type"),
}
# Header fragments accepted in uploaded files.
UPLOAD_ALIASES = {
    "habitaciones": ("habitaciones", "rooms", "bedrooms"),
    "banos": ("baños", "banos", "bathrooms", "baths"),
    "precio": ("precio", "price", "cost"),
    "link_inmueble": ("link_inmueble", "link", "url", "enlace"),
    "metros_cuadrados": ("metros_cuadrados", "metros", "m2", "sqm", "square_meters"),
    "anunciante": ("anunciante", "advertiser", "agency", "agencia"),
    "zona": ("zona", "zone", "area", "location", "ubicacion"),
    "web": ("web", "website", "portal", "site"),
    "fecha_inclusion": ("fecha_inclusion", "fecha", "date", "created_at"),
    "tipo_de_operacion": ("tipo_de_operacion", "tipo_operacion", "operacion", "operation_type", "type"),
}
UPLOAD_REQUIRED = ("habitaciones", "banos", "precio", "metros_cuadrados", "zona")
