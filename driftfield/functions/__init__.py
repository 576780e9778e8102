"""Column functions: numbers, time, quantization, quaternions."""
