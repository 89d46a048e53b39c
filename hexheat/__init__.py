"""hexheat: fold gridded forecasts onto hexagons and follow heat through time, on Spark."""
