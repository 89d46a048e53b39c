"""Column functions. All are built-in expressions, so they stay inside generated code."""

from hexheat.functions.cells import (  # noqa: F401
    axial_of, cell_area_km2, cell_at, cell_centre, cell_from_hex, cell_hex, cell_of, centre_of_axial,
    edge_km, id_of_axial,
)
from hexheat.functions.colour import hex_rgb, ramp_position, ramp_rgb  # noqa: F401
from hexheat.functions.heat import (  # noqa: F401
    c_to_f, decay, dequantise_hi, dequantise_load, f_to_c, flush_factor, heat_index_c, heat_index_of,
    is_finite, is_present, or_nan, or_null, or_zero, pack_wx, quantise_hi, quantise_load, rain_mm, unpack_rain, unpack_wind,
    vented_excess, wind_speed,
)
from hexheat.functions.text import (  # noqa: F401
    county_label, division_key, path_tail, region_suffix, shard_index, shard_name, value_label,
)
from hexheat.functions.tiles import (  # noqa: F401
    hilbert_id, lonlat_to_tile, tile_to_lonlat, zigzag,
)
from hexheat.functions.times import clamp_day, day_count, hour_label, valid_time  # noqa: F401
