"""Analytics over large multichannel rasters, as DataFrame operators."""
