"""Pure Python readers of note formats; wrapped once by Arrow UDFs in vaultspark.sources.formats."""
